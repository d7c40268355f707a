"""Items and the baskets they lie in: supports, frequent pairs and how strongly pairs are associated.

A basket relation has two columns, basket and item. Rows with a null in either are dropped,
and an item counts once a basket. Pairs are unordered, with item_i < item_j.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("jaccard", "root_jaccard", "pmi", "weighted_pmi")


def basket_relation(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """(basket, item), distinct and without nulls; an empty table stays empty."""
    both = rows.select(F.col(basket).alias("basket"), F.col(item).alias("item"))
    return both.where("basket is not null and item is not null").distinct()


def item_sets(relation: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values, n): the sorted distinct values of each key; for keys with moderately many values."""
    rows = relation.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    sets = rows.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set(value)).alias("values"))
    return sets.withColumn("n", F.size("values").cast("long"))


def basket_count(relation: DataFrame) -> DataFrame:
    """One row, n: how many baskets there are."""
    return relation.select("basket").distinct().agg(F.count(F.lit(1)).alias("n"))


def without_items(relation: DataFrame, excluded: DataFrame) -> DataFrame:
    """The relation without the items of a one-column table; baskets that this empties still count elsewhere."""
    return relation.join(excluded.toDF("item"), "item", "left_anti").select("basket", "item")


def item_support(relation: DataFrame) -> DataFrame:
    """(item, n_item, support): the share of baskets that hold the item."""
    counted = relation.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    return counted.crossJoin(F.broadcast(basket_count(relation))).select(  # the other side is one row
        "item", "n_item", (F.col("n_item") / F.col("n")).alias("support")
    )


#: Items of one list; a larger basket is cut into blocks of about this size, and pairs of blocks are joined.
BLOCK = 64


def pairs_within(items: str) -> Column:
    """One row for each pair a < b of a sorted list of distinct items."""
    of_each = F.transform(
        F.col(items),
        lambda x, i: F.transform(
            F.slice(F.col(items), i + 2, F.greatest(F.size(items) - i - 1, F.lit(0))),
            lambda y: F.struct(x.alias("a"), y.alias("b")),
        ),
    )
    return F.explode(F.flatten(of_each))


def met_pairs(relation: DataFrame, keys: Sequence[str], item: str, kept: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(*kept, item_i, item_j, n_ij): in how many baskets, given by the columns `keys`, both items lie, item_i < item_j.

    relation has distinct rows without nulls; kept are those of `keys` by which pairs are counted separately. Baskets of the same
    items are collapsed into one of their number, so that pairs are enumerated once per distinct basket. A basket of
    more than two blocks is cut by the items' hash, and its blocks meet two by two, each pair under a key of its
    own: no task holds more than two blocks of a basket.
    """
    keys, kept = list(keys), list(kept)
    sizes = relation.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    sized = relation.select(*keys, F.col(item).alias("_item")).join(sizes, keys)
    blocks = F.when(F.col("_size") > 2 * block, F.ceil(F.col("_size") / block)).otherwise(1).cast("int")
    placed = sized.withColumn("_blocks", blocks).withColumn("_at", F.pmod(F.xxhash64("_item"), F.col("_blocks")).cast("int"))
    lists = placed.groupBy(*keys, "_blocks", "_at").agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    small = lists.where("_blocks = 1").groupBy(*kept, "_items").agg(F.count(F.lit(1)).alias("_w"))
    large = lists.where("_blocks > 1")
    # the content of a large basket is told by the digests of its blocks
    digest = F.sha2(F.to_json(F.struct("_items")), 256)
    signed = large.select(*keys, "_blocks", F.struct("_at", digest.alias("d")).alias("_d")).groupBy(*keys, "_blocks").agg(
        F.sha2(F.to_json(F.struct(F.array_sort(F.collect_list("_d")))), 256).alias("_sign")
    )
    one = F.min(F.struct(*keys)).alias("_one")
    distinct = signed.groupBy(*kept, "_blocks", "_sign").agg(one, F.count(F.lit(1)).alias("_w")).select(F.col("_one.*"), "_w")
    parts = large.join(distinct, keys)
    partners = F.explode(F.sequence(F.col("_at") + 1, F.col("_blocks") - 1))
    ahead = parts.where(F.col("_at") < F.col("_blocks") - 1).select(*keys, "_w", F.col("_items").alias("_x"), partners.alias("_at"))
    across = ahead.join(parts.select(*keys, "_at", F.col("_items").alias("_y")), [*keys, "_at"])
    across = across.select(*kept, "_w", F.explode("_x").alias("x"), "_y").select(*kept, "_w", "x", F.explode("_y").alias("y"))
    across = across.select(*kept, "_w", F.struct(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).alias("_p"))
    inside = small.select(*kept, "_w", pairs_within("_items").alias("_p")).unionByName(parts.select(*kept, "_w", pairs_within("_items").alias("_p")))
    return inside.unionByName(across).groupBy(*kept, F.col("_p.a").alias("item_i"), F.col("_p.b").alias("item_j")).agg(F.sum("_w").alias("n_ij"))


def pair_counts(relation: DataFrame, min_count: int = 1) -> DataFrame:
    """(item_i, item_j, n_ij): in how many baskets both items lie, of pairs in at least min_count of them.

    Items that lie in fewer baskets than that are dropped first, as no pair with them can reach it.
    """
    frequent = relation.groupBy("item").count().where(F.col("count") >= min_count).select("item")
    kept = relation.join(frequent, "item", "left_semi") if min_count > 1 else relation
    return met_pairs(kept, ["basket"], "item").where(F.col("n_ij") >= min_count)


def _score(metric: str, min_support: float) -> Column:
    i, j, ij, n = (F.col(c) for c in ("n_i", "n_j", "n_ij", "n"))
    lift = ij * n / (i * j)
    if metric in ("jaccard", "root_jaccard"):
        return ij / (i + j - ij)
    if metric == "pmi":
        return F.ln(lift)
    if metric == "weighted_pmi":
        # half of the least count is taken as observed by chance
        chance = F.floor(F.floor(n * F.lit(min_support)) / 2)
        return F.ln(lift * (ij - chance) / ij + chance / ij)
    raise ValueError(f"unknown metric: {metric}")


def frequent_pairs(
    relation: DataFrame,
    metric: str = "pmi",
    min_support: float = 0.0,
    excluded: DataFrame | None = None,
) -> DataFrame:
    """(item_i, item_j, n_ij, score) of the pairs with support of at least min_support.

    The number of baskets is that before `excluded` items are taken out. The Jaccard metrics
    use the whole relation, the others supports of the filtered one; as a pair never
    has an excluded item, the counts are the same. Scores are not normalised.
    """
    kept = relation if excluded is None else without_items(relation, excluded)
    total = F.broadcast(basket_count(relation))  # one row
    counted = kept.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).crossJoin(total)
    # every item of a frequent pair is frequent
    counted = counted.where(F.col("n_item") >= F.col("n") * F.lit(min_support)) if min_support > 0 else counted
    single = counted.select("item", "n_item", "n")
    useful = kept.join(single.select("item"), "item", "left_semi") if min_support > 0 else kept
    pairs = met_pairs(useful, ["basket"], "item")
    scored = pairs.join(single.select(F.col("item").alias("item_i"), F.col("n_item").alias("n_i"), "n"), "item_i").join(
        single.select(F.col("item").alias("item_j"), F.col("n_item").alias("n_j")), "item_j"
    )
    scored = scored.where(F.col("n_ij") >= F.col("n") * F.lit(min_support)) if min_support > 0 else scored
    return scored.select("item_i", "item_j", "n_ij", _score(metric, min_support).alias("score"))


def normalized(pairs: DataFrame, metric: str = "pmi", by: Sequence[str] = ()) -> DataFrame:
    """pairs with scores divided by the greatest score (of each group of columns `by`).

    The root is taken after dividing if the metric's name has `root` in it. If the greatest
    score isn't positive, scores become null: no score of it would be kept. An empty table stays empty.
    """
    top = pairs.groupBy(*by).agg(F.max("score").alias("top")) if by else pairs.agg(F.max("score").alias("top"))
    joined = pairs.join(F.broadcast(top), list(by)) if by else pairs.crossJoin(F.broadcast(top))  # a row per source
    share = F.when(F.col("top") > 0, F.col("score") / F.col("top"))
    if "root" in metric:
        share = F.when(share >= 0, F.sqrt(share))
    return joined.withColumn("score", share).drop("top")


def scored_pairs(rows: DataFrame, basket: str, item: str, metric: str, min_support: float, excluded: DataFrame | None = None) -> DataFrame:
    """(item_i, item_j, score): relation, frequent pairs and normalisation in one."""
    pairs = frequent_pairs(basket_relation(rows, basket, item), metric, min_support, excluded)
    return normalized(pairs, metric).select("item_i", "item_j", "score")


def merged_by_maximum(sources: Sequence[DataFrame]) -> DataFrame:
    """(item_i, item_j, score): of several sources of positive normalised scores the greatest per pair."""
    whole = sources[0]
    for source in sources[1:]:
        whole = whole.unionByName(source)
    return whole.where("score > 0").groupBy("item_i", "item_j").agg(F.max("score").alias("score"))


def score_histogram(pairs: DataFrame, width: float) -> DataFrame:
    """(bucket, low, n): how many pairs have a score from low on, in buckets of a width."""
    bucket = F.floor(F.col("score") / width)
    counted = pairs.where("score is not null").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bucket", (F.col("bucket") * width).alias("low"), "n")
