"""Graphs of scored pairs: bottlenecks of merge sets, node and edge tables, clusters."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators import cuts
from linkloom.operators.mergesets import merge_sets
from linkloom.runtime import written

#: Edges of one component up to which it is a matrix of its own, and of one block up to which its paths are followed within one task.
EXACT_EDGES = 2_000
#: Vertices of a larger block from which a task follows the shortest paths at once; in the end they are followed from all.
SOURCES = 64


def edge_betweenness(edges: list[tuple[int, int]], n: int) -> dict[tuple[int, int], float]:
    """Shortest paths through each edge, as a share of all pairs of vertices."""
    near: list[list[int]] = [[] for _ in range(n)]
    for u, v in edges:
        near[u].append(v)
        near[v].append(u)
    through = dict.fromkeys(((min(e), max(e)) for e in edges), 0.0)
    for source in range(n):
        far, paths, before, order = [-1] * n, [0.0] * n, [[] for _ in range(n)], []
        far[source], paths[source] = 0, 1.0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if far[w] < 0:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = [0.0] * n
        for w in reversed(order):
            for v in before[w]:
                part = paths[v] / paths[w] * (1 + share[w])
                through[min(v, w), max(v, w)] += part
                share[v] += part
    pairs = n * (n - 1)
    return {e: x / pairs for e, x in through.items()} if pairs else through


def algebraic_connectivity(edges: list[tuple[int, int]], n: int) -> float:
    """The second smallest eigenvalue of the normalised Laplacian."""
    a = np.zeros((n, n))
    for u, v in edges:
        a[u, v] = a[v, u] = 1
    scale = 1 / np.sqrt(np.maximum(a.sum(0), 1))
    return float(np.linalg.eigvalsh(np.eye(n) - scale[:, None] * a * scale[None, :])[1]) if n > 1 else 0.0


def _small_connectivities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(set_id, connectivity) of components (set_id, x, y), the rows of one behind one another."""

    def of(edges: pd.DataFrame) -> pd.DataFrame:
        rows, codes = [], pd.factorize(pd.concat([edges["x"], edges["y"]]), sort=True)[0].reshape(2, -1)
        for name, at in edges.groupby("set_id", sort=False).indices.items():
            ends, local = np.unique(codes[:, at], return_inverse=True)
            rows.append((name, algebraic_connectivity(local.reshape(2, -1).T.tolist(), len(ends))))
        return pd.DataFrame(rows, columns=["set_id", "connectivity"])

    rest = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        open_ = rest["set_id"] == rest["set_id"].iloc[-1] if len(rest) else []
        if len(rest) and not open_.all():
            yield of(rest[~open_])
            rest = rest[open_]
    if rest is not None and len(rest):
        yield of(rest)


def _coded(large: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components (set_id, x, y) as numbers: edges (no, i, j), vertices (no, i, name) by their names, sets (set_id, no)."""
    sets = written(large.select("set_id").distinct().withColumn("no", F.row_number().over(Window.orderBy("set_id"))))
    edges = large.join(F.broadcast(sets), "set_id").select("no", "x", "y")
    names = edges.select("no", F.explode(F.array("x", "y")).alias("name")).distinct()
    vertices = written(names.withColumn("i", F.row_number().over(Window.partitionBy("no").orderBy("name")) - F.lit(1).cast("long")))
    coded = edges.join(vertices.toDF("no", "x", "i"), ["no", "x"]).join(vertices.toDF("no", "y", "j"), ["no", "y"])
    return written(coded.select("no", "i", "j")), vertices.select("no", "i", "name"), sets


def _large_betweenness(edges: DataFrame, block_edges: int, sources: int) -> DataFrame:
    """(no, i, j, betweenness): the edge most paths go through, of each component (no, i, j) of numbered vertices.

    Blocks of more than block_edges edges are followed from all their vertices, which are divided among tasks.
    """

    def blocks(component: pd.DataFrame) -> pd.DataFrame:
        u, v = component["i"].to_numpy(), component["j"].to_numpy()
        n = int(max(u.max(), v.max())) + 1
        loads, left = cuts.edge_loads(u, v, n, block_edges, sources)
        rows = [(None, None, None, *(np.asarray(x, np.int64).tobytes() for x in block)) for block in left]
        if not np.isnan(loads).all():
            shares = loads / (n * (n - 1) / 2)
            k = np.lexsort((v, u, -np.nan_to_num(shares, nan=-1.0).round(12)))[0]
            rows.append((u[k], v[k], shares[k], None, None, None, None))
        return pd.DataFrame([(component["no"].iloc[0], n, *row) for row in rows], columns=["no", "n", "i", "j", "betweenness", "u", "v", "weights", "vertices"])

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                u, v, weights, vertices = (np.frombuffer(x, np.int64) for x in (row.u, row.v, row.weights, row.vertices))
                loads = cuts.followed_loads(u, v, weights, np.arange(row.part, len(weights), parts), sources)
                i, j = vertices[u], vertices[v]
                yield pd.DataFrame({"no": row.no, "n": row.n, "i": np.minimum(i, j), "j": np.maximum(i, j), "load": loads})

    parts = 4 * edges.sparkSession.sparkContext.defaultParallelism
    found = written(edges.groupBy("no").applyInPandas(blocks, "no int, n long, i long, j long, betweenness double, u binary, v binary, weights binary, vertices binary"))
    most, left = found.where("u is null").select("no", "i", "j", "betweenness"), found.where("u is not null")
    if not left.isEmpty():
        tasks = left.select("no", "n", "u", "v", "weights", "vertices", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(parts)
        loads = tasks.mapInPandas(follow, "no int, n long, i long, j long, load double").groupBy("no", "n", "i", "j").agg(F.sum("load").alias("load"))
        most = most.unionByName(loads.select("no", "i", "j", (F.col("load") / (F.col("n") * (F.col("n") - 1) / 2)).alias("betweenness")))
    best = F.min(F.struct((-F.round("betweenness", 12)).alias("less"), "i", "j", "betweenness"))
    return most.groupBy("no").agg(best.alias("m")).select("no", "m.i", "m.j", "m.betweenness")


def bottlenecks(pairs: DataFrame, a: str, b: str, min_edges: int = 4, top: int = 100, exact_edges: int = EXACT_EDGES, sources: int = SOURCES) -> DataFrame:
    """(set_id, term1, term2, betweenness, connectivity): the edge most paths go through, of each component of at least min_edges.

    The components least connected come first; equal to 12 digits, by set_id. Only of those that come out the paths are
    followed. Both figures are exact at every size: a component of more than exact_edges edges is reduced by elimination
    for its connectivity and cut into blocks for its paths; in a block of more than exact_edges edges they are followed
    from all its vertices by many tasks, from `sources` of them at once.
    """
    edges = pairs.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x <> y").distinct()
    placed = edges.join(merge_sets(edges, "x", "y").withColumnRenamed("member", "x"), "x")
    sized = placed.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_edges")).where(F.col("n_edges") >= min_edges)
    placed = written(placed.join(sized, "set_id"))
    parts = 4 * pairs.sparkSession.sparkContext.defaultParallelism

    def worst(component: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*component["x"], *component["y"]})
        at = {name: k for k, name in enumerate(names)}
        through = edge_betweenness([(at[x], at[y]) for x, y in zip(component["x"], component["y"])], len(names))
        (u, v), most = min(through.items(), key=lambda e: (-round(e[1], 12), e[0]))
        return pd.DataFrame([(component["set_id"].iloc[0], names[u], names[v], most)], columns=["set_id", "term1", "term2", "betweenness"])

    def reduced(component: pd.DataFrame) -> pd.DataFrame:
        u, v = component["i"].to_numpy(), component["j"].to_numpy()
        value = cuts.algebraic_connectivity(u, v, int(max(u.max(), v.max())) + 1)
        return pd.DataFrame([(component["no"].iloc[0], value)], columns=["no", "connectivity"])

    small = placed.where(F.col("n_edges") <= exact_edges).select("set_id", "x", "y").repartition(parts, "set_id")
    large = placed.where(F.col("n_edges") > exact_edges).select("set_id", "x", "y")
    connected = small.sortWithinPartitions("set_id").mapInPandas(_small_connectivities, "set_id string, connectivity double")
    any_large = not large.isEmpty()
    if any_large:
        coded, vertices, sets = _coded(large)
        values = coded.groupBy("no").applyInPandas(reduced, "no int, connectivity double")
        connected = connected.unionByName(values.join(sets, "no").select("set_id", "connectivity"))
    order = [F.round("connectivity", 12), "set_id"]
    first = written(connected.orderBy(*order).limit(top))
    found = small.join(first, "set_id", "left_semi").groupBy("set_id").applyInPandas(worst, "set_id string, term1 string, term2 string, betweenness double")
    if any_large:
        chosen = coded.join(sets.join(first, "set_id"), "no", "left_semi")
        most = _large_betweenness(chosen, exact_edges, sources).join(sets, "no")
        most = most.join(vertices.toDF("no", "i", "term1"), ["no", "i"]).join(vertices.toDF("no", "j", "term2"), ["no", "j"])
        found = found.unionByName(most.select("set_id", "term1", "term2", "betweenness"))
    return found.join(first, "set_id").select("set_id", "term1", "term2", "betweenness", "connectivity").orderBy(*order)


def sector_number(sector: Column) -> Column:
    return F.when(sector == "government", 0).when(sector == "company", 1).otherwise(2)


def node_table(relation: DataFrame, pairs: DataFrame, sectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """(item, sector, sector_num, cluster, log_count) of the items of surviving pairs; log_count is 2 ln of their baskets."""
    used = pairs.select(F.explode(F.array("item_i", "item_j")).alias("item")).distinct()
    counts = relation.groupBy("item").agg(F.count_distinct("basket").alias("n"))
    joined = used.join(counts, "item", "left").join(sectors, "item", "left").join(clusters, "item", "left")
    sector = F.coalesce("sector", F.lit("other"))
    return joined.select("item", sector.alias("sector"), sector_number(sector).alias("sector_num"), "cluster", (2 * F.ln("n")).alias("log_count"))


def edge_table(pairs: DataFrame, sectors: DataFrame) -> DataFrame:
    """(item_i, item_j, weight, types): types is 1 between a government and a company, else 0.4."""
    i, j = sectors.toDF("item_i", "s_i"), sectors.toDF("item_j", "s_j")
    joined = pairs.join(i, "item_i", "left").join(j, "item_j", "left")
    across = ((F.col("s_i") == "government") & (F.col("s_j") == "company")) | ((F.col("s_i") == "company") & (F.col("s_j") == "government"))
    return joined.select("item_i", "item_j", F.col("score").alias("weight"), F.when(across, 1.0).otherwise(0.4).alias("types"))


def within_clusters(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """The edges whose two ends lie in one cluster, with it."""
    i, j = clusters.toDF("item_i", "cluster"), clusters.toDF("item_j", "c_j")
    return edges.join(i, "item_i").join(j, "item_j").where(F.col("cluster") == F.col("c_j")).drop("c_j")


def k_means(points: DataFrame, id_column: str, vector: str, k: int, iterations: int = 10, seed: int = 0) -> DataFrame:
    """(id_column, cluster, distance): Lloyd's algorithm from a D-squared seeding; distance to the centre isn't squared."""
    rows = points.select(F.col(id_column), F.col(vector).cast("array<double>").alias("_v")).where("_v is not null")
    model = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="_f", predictionCol="cluster").fit(rows.withColumn("_f", array_to_vector("_v")))
    centres = F.array(*[F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()])
    placed = model.transform(rows.withColumn("_f", array_to_vector("_v")))
    centre = F.get(centres, F.col("cluster"))
    squares = F.zip_with("_v", centre, lambda x, y: (x - y) * (x - y))
    return placed.select(id_column, "cluster", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)).alias("distance"))


#: Multiplications between two orthonormalisations, and how many of these.
STEPS = 6
ROUNDS = 5


def leading_vectors(pairs: DataFrame, k: int, rounds: int = ROUNDS, steps: int = STEPS) -> DataFrame:
    """(item, degree, v): rows of an orthonormal basis of about the k leading eigenvectors of the normalised affinity.

    pairs: item_i, item_j, score, positive. Block power iteration on half the sum of the identity and the affinity
    scaled by the roots of the degrees; a multiplication is a join and a sum, only k x k matrices reach the driver. The part
    of an eigenvector left out shrinks by ((1 + b) / (1 + a)) ** (rounds * steps), a and b the k-th and the next eigenvalue.
    k is at most the number of items.
    """
    both = pairs.where("score > 0").select("item_i", "item_j", "score")
    both = both.unionByName(both.toDF("item_j", "item_i", "score")).groupBy("item_i", "item_j").agg(F.sum("score").alias("w"))
    edges = written(both)
    degrees = written(edges.groupBy("item_i").agg(F.sum("w").alias("degree")).toDF("item", "degree"))
    k = max(1, min(k, degrees.count()))
    root = lambda name: degrees.select(F.col("item").alias(name), F.sqrt("degree").alias(f"r_{name}"))
    scaled = edges.join(root("item_i"), "item_i").join(root("item_j"), "item_j")
    scaled = scaled.select("item_i", "item_j", (F.col("w") / (2 * F.col("r_item_i") * F.col("r_item_j"))).alias("w"))
    loops = degrees.select(F.col("item").alias("item_i"), F.col("item").alias("item_j"), F.lit(0.5).alias("w"))
    scaled = written(scaled.unionByName(loops))
    start = [(F.pmod(F.xxhash64(F.lit(c), "item"), F.lit(1 << 20)) / (1 << 19) - 1).alias(f"v{c}") for c in range(k)]
    vectors = degrees.select("item", *start)
    names = [f"v{c}" for c in range(k)]
    for _ in range(rounds):
        for _ in range(steps):
            met = scaled.join(vectors.withColumnRenamed("item", "item_j"), "item_j")
            vectors = met.groupBy(F.col("item_i").alias("item")).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])
        vectors = written(vectors)
        products = vectors.agg(*[F.sum(F.col(names[x]) * F.col(names[y])).alias(f"g{x}_{y}") for x in range(k) for y in range(x, k)]).collect()[0]
        gram = np.array([[products[f"g{min(x, y)}_{max(x, y)}"] or 0.0 for y in range(k)] for x in range(k)])
        values, turned = np.linalg.eigh(gram)
        kept = values > values.max() * 1e-12
        to = turned[:, kept] / np.sqrt(values[kept])
        names = [f"v{c}" for c in range(to.shape[1])]
        mixed = [sum((F.col(f"v{x}") * float(to[x, c]) for x in range(k)), F.lit(0.0)).alias(f"v{c}") for c in range(to.shape[1])]
        vectors, k = vectors.select("item", *mixed), to.shape[1]
    return written(vectors.join(degrees, "item").select("item", "degree", F.array(*names).alias("v")))


def _grouped(points: DataFrame, k: int, iterations: int, seed: int) -> DataFrame:
    """(item, cluster) of points (item, v) by k-means; clusters are numbered by their least items."""
    if points.isEmpty():
        return points.sparkSession.createDataFrame([], "item string, cluster int")
    rows = points.repartition(8, "item").sortWithinPartitions("item").withColumn("_f", array_to_vector("v"))
    model = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="_f", predictionCol="cluster").fit(rows) if k > 1 else None
    placed = model.transform(rows).select("item", "cluster") if model else rows.select("item", F.lit(0).alias("cluster"))
    placed = written(placed)
    least = placed.groupBy("cluster").agg(F.min("item").alias("least")).orderBy("least").collect()  # k rows
    number = F.create_map(*[F.lit(x) for n, r in enumerate(least) for x in (r["cluster"], n)])
    return placed.select("item", number[F.col("cluster")].alias("cluster"))


def spectral_clusters(pairs: DataFrame, k: int = 20, iterations: int = 10, seed: int = 0) -> DataFrame:
    """(item, cluster) of the items of scored pairs; clusters are numbered by their least items.

    Rows of the k leading vectors of the normalised affinity, brought to unit length, go through k-means, at every size the
    same. Pairs without a positive score link nothing; an item with only such pairs doesn't come out.
    """
    found = leading_vectors(pairs, k) if not pairs.where("score > 0").isEmpty() else None
    if found is None:
        return pairs.sparkSession.createDataFrame([], "item string, cluster int")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return _grouped(found.select("item", F.transform("v", lambda x: x / length).alias("v")), k, iterations, seed)


def co_clusters(pairs: DataFrame, sectors: DataFrame, k: int = 19, iterations: int = 10, seed: int = 0) -> DataFrame:
    """(item, cluster): governments and companies clustered together by their pairs; all other items get cluster k.

    Bipartite spectral co-clustering: the leading vectors of the bipartite pairs hold the singular vectors of the matrix scaled
    by its row and column sums; divided by the roots of these sums they go through k-means.
    """
    crossed = edge_table(pairs, sectors).where((F.col("types") == 1.0) & (F.col("weight") > 0))
    items = pairs.select(F.explode(F.array("item_i", "item_j")).alias("item")).distinct()
    if crossed.isEmpty():
        return items.select("item", F.lit(k).alias("cluster"))
    # the first vector is the same for all items then, so that it makes no distances
    many = 1 + max(1, int(np.ceil(np.log2(max(k, 2)))))
    found = leading_vectors(crossed.select("item_i", "item_j", F.col("weight").alias("score")), many)
    points = found.select("item", F.transform("v", lambda x: x / F.sqrt("degree")).alias("v"))
    placed = _grouped(points, k, iterations, seed)
    return items.join(placed, "item", "left").select("item", F.coalesce("cluster", F.lit(k)).cast("int").alias("cluster"))
