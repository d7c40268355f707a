"""Groups of terms linked directly or through others.

The giant component is peeled by frontier joins from the vertex of the highest degree and
taken away by an anti-join; minimum propagation labels what remains. Each round of the
propagation contracts the graph to the minima found, in an order drawn anew, so that long
chains shrink by about half in every round and the rounds grow with the logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.runtime import forget, written


def _both_ways(pairs: DataFrame) -> DataFrame:
    back = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return pairs.unionByName(back)


def _order(vertex: Column, round_: int) -> Column:
    """The place of a vertex in the order of a round; ties of the hash go by the term."""
    return F.struct(F.xxhash64(F.lit(round_), vertex), vertex.alias("v"))


def _peel(edges: DataFrame, hub, levels: int) -> tuple[list[DataFrame], bool]:
    """The levels of a breadth-first search from the hub, and whether it came to its end."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(hub,)], edges.select("u").schema)
    found = [start]
    for _ in range(levels):
        reached = edges.join(found[-1], "u", "left_semi").select(F.col("v").alias("u")).distinct()
        for level in found[-2:]:  # neighbours of a level lie on it or on one next to it
            reached = reached.join(level, "u", "left_anti")
        reached = written(reached)
        if reached.isEmpty():
            return found, True
        found.append(reached)
    return found, False


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _propagated(edges: DataFrame) -> DataFrame | None:
    """(u, label) of every vertex of the edges; label is one vertex of its component."""
    maps: list[DataFrame] = []
    current = edges
    while True:
        nearest = (
            current.groupBy("u")
            .agg(F.min(_order(F.col("v"), len(maps))).alias("least"))
            .select("u", F.least(F.col("least"), _order(F.col("u"), len(maps)))["v"].alias("p"))
        )
        step = written(nearest)
        if step.isEmpty():
            break
        maps.append(step)
        ends = current.join(step, "u").select(F.col("p").alias("pu"), F.col("v").alias("u"))
        ends = ends.join(step, "u").select(F.col("pu").alias("u"), F.col("p").alias("v"))
        contracted = written(ends.where("u <> v").distinct())
        if len(maps) > 1:
            forget(current)
        current = contracted
    if not maps:
        return None
    label = maps[-1].select("u", F.col("p").alias("label"))
    for step in reversed(maps[:-1]):
        later = label.select(F.col("u").alias("p"), "label")
        label = written(step.join(later, "p", "left").select("u", F.coalesce("label", "p").alias("label")))
    return label


def components(pairs: DataFrame, a: str, b: str, levels: int = 8) -> DataFrame:
    """(group_term, term): each distinct non-null term of two columns with the least term of its group.

    Terms are compared exactly as written. A row with both sides links them, in either
    orientation and however often it occurs; a pair of a term with itself or with a null side links
    nothing, but its term is reported, in a group of its own if nothing else links it.
    Empty strings are terms like any other; an empty table gives no row. Other columns are ignored.

    levels bounds the rounds of the search from the hub, not its result: if the search has
    not ended by then, what it found becomes one vertex of the graph that is propagated.
    """
    sides = pairs.select(F.col(a).alias("u"), F.col(b).alias("v"))
    terms = sides.select(F.explode(F.array("u", "v")).alias("term")).where("term is not null").distinct()
    once = sides.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = written(_both_ways(once))
    top = edges.groupBy("u").count().orderBy(F.desc("count"), "u").limit(1).collect()
    if not top:
        return terms.select(F.col("term").alias("group_term"), "term")
    hub = top[0]["u"]
    found, ended = _peel(edges, hub, levels)
    giant = _union(found)
    if ended:
        rest = written(edges.join(giant, "u", "left_anti"))
        least = giant.agg(F.min("u")).collect()[0][0]
        peeled = giant.select(F.lit(least).alias("group_term"), F.col("u").alias("term"))
    else:
        mark = giant.withColumn("g", F.lit(True))
        half = edges.join(mark, "u", "left").select(
            F.when(F.col("g"), F.lit(hub)).otherwise(F.col("u")).alias("pu"), F.col("v").alias("u")
        )
        whole = half.join(mark, "u", "left").select(
            F.col("pu").alias("u"), F.when(F.col("g"), F.lit(hub)).otherwise(F.col("u")).alias("v")
        )
        rest = written(whole.where("u <> v").distinct())
        peeled = None
    label = _propagated(rest)
    if label is None:
        named = peeled
    else:
        if peeled is None:
            inside = giant.where(F.col("u") != F.lit(hub)).withColumn("at", F.lit(hub))
            root = label.where(F.col("u") == F.lit(hub)).select(F.col("u").alias("at"), "label")
            label = written(label.unionByName(inside.join(root, "at").select("u", "label")))
        names = label.groupBy("label").agg(F.min("u").alias("group_term"))
        named = label.join(names, "label").select("group_term", F.col("u").alias("term"))
        if peeled is not None:
            named = named.unionByName(peeled)
    alone = terms.join(edges.select(F.col("u").alias("term")), "term", "left_anti")
    return named.unionByName(alone.select(F.col("term").alias("group_term"), "term"))
