"""Directed association rules, their best per consequent, and comparisons of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.baskets import basket_count, frequent_pairs


def association_rules(relation: DataFrame, min_support: float = 0.0) -> DataFrame:
    """(antecedent, consequent, confidence, lift, interest, antecedent_support, consequent_support), both directions of each pair.

    interest is confidence less the support of the consequent.
    """
    total = F.broadcast(basket_count(relation))  # one row
    support = relation.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).crossJoin(total)
    pairs = frequent_pairs(relation, "pmi", min_support).select("item_i", "item_j", "n_ij")
    ways = F.array(
        F.struct(F.col("item_i").alias("antecedent"), F.col("item_j").alias("consequent")),
        F.struct(F.col("item_j").alias("antecedent"), F.col("item_i").alias("consequent")),
    )
    directed = pairs.select("n_ij", F.explode(ways).alias("w")).select("w.*", "n_ij")
    a = support.select(F.col("item").alias("antecedent"), F.col("n_item").alias("n_a"), "n")
    c = support.select(F.col("item").alias("consequent"), F.col("n_item").alias("n_c"))
    joined = directed.join(a, "antecedent").join(c, "consequent")
    confidence = F.col("n_ij") / F.col("n_a")
    return joined.select(
        "antecedent",
        "consequent",
        confidence.alias("confidence"),
        (F.col("n_ij") * F.col("n") / (F.col("n_a") * F.col("n_c"))).alias("lift"),
        (confidence - F.col("n_c") / F.col("n")).alias("interest"),
        (F.col("n_a") / F.col("n")).alias("antecedent_support"),
        (F.col("n_c") / F.col("n")).alias("consequent_support"),
    )


def names_of_type(matches: DataFrame, type_: str, names: tuple[str, str] = ("org_name", "entity_name")) -> DataFrame:
    """(item): typed and linked names of the rows of one type, distinct."""
    rows = matches.where(F.col("type") == type_)
    return rows.select(F.explode(F.array(*names)).alias("item")).where("item is not null").distinct()


def rules_between(rules: DataFrame, companies: DataFrame, governments: DataFrame, min_interest: float = 0.25) -> DataFrame:
    """The rules from a company to a government with at least this interest.

    companies and governments have a column item; an item may be in both. Of a pair that both ways fit,
    the rule with the lesser antecedent is kept.
    """
    company = companies.select(F.col("item").alias("antecedent")).distinct()
    government = governments.select(F.col("item").alias("consequent")).distinct()
    fit = rules.join(company, "antecedent", "left_semi").join(government, "consequent", "left_semi")
    pair = Window.partitionBy(F.least("antecedent", "consequent"), F.greatest("antecedent", "consequent"))
    first = fit.withColumn("_k", F.row_number().over(pair.orderBy("antecedent"))).where("_k = 1").drop("_k")
    return first.where(F.col("interest") >= min_interest).select(rules.columns)


def top_per_consequent(rules: DataFrame, k: int = 3) -> DataFrame:
    """(government, `top 1` ... `top k`): the antecedents of each consequent by interest, '' where there are fewer."""
    order = Window.partitionBy("consequent").orderBy(F.desc("interest"), "antecedent")
    ranked = rules.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    wide = ranked.groupBy(F.col("consequent").alias("government")).pivot("_rank", list(range(1, k + 1))).agg(F.first("antecedent"))
    return wide.select("government", *[F.coalesce(F.col(str(r)), F.lit("")).alias(f"top {r}") for r in range(1, k + 1)])


def ranked(pairs: DataFrame, name: str) -> DataFrame:
    """(item_i, item_j, name): the place of each pair by score, greatest first, ties by the items.

    The ranks are those of a global sort: pairs are range partitioned by score, and counts of the partitions before are added.
    """
    order = [F.desc("score"), F.asc("item_i"), F.asc("item_j")]
    placed = pairs.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("item_i", "item_j", "score", F.spark_partition_id().alias("_part"))
    within = Window.partitionBy("_part").orderBy(*order)
    local = placed.withColumn("_at", F.row_number().over(within))
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return local.join(offsets, "_part").select("item_i", "item_j", (F.col("_at") + F.col("_before")).cast("long").alias(name))


def rank_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """(item_i, item_j, rank_1, rank_2, difference) of the pairs that both rankings have."""
    both = ranked(first, "rank_1").join(ranked(second, "rank_2"), ["item_i", "item_j"])
    return both.withColumn("difference", F.col("rank_1") - F.col("rank_2"))


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The k pairs with the greatest scores, ties by the items."""
    return pairs.orderBy(F.desc("score"), "item_i", "item_j").limit(k)


def only_in_first(first: DataFrame, second: DataFrame, k: int = 50) -> DataFrame:
    """(item_i, item_j): pairs among the k best of the first ranking but not of the second."""
    return top_pairs(first, k).join(top_pairs(second, k), ["item_i", "item_j"], "left_anti").select("item_i", "item_j")


def sample_rows(rows: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows, chosen by a hash of the keys and the seed: the same rows in every run."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def sample_of_top(rows: DataFrame, keys: list[str], score: str, top: int, n: int, seed: int = 0) -> DataFrame:
    """n rows out of the `top` with the greatest score."""
    return sample_rows(rows.orderBy(F.desc(score), *keys).limit(top), keys, n, seed)
