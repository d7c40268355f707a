"""How often pairs of items meet in one basket, and how that compares with chance.

Identical item lists, of large baskets as well, are collapsed into one weighted basket; pairs are enumerated
once per distinct basket and the weights summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.baskets import BLOCK, met_pairs
from linkloom.runtime import written


def letters_and_digits(name: Column) -> Column:
    """A name reduced to its letters and digits in lower case; null if it has none."""
    bare = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")
    return F.when(bare != "", bare)


def items_together(
    rows: DataFrame,
    kind: str,
    basket: str,
    item: str,
    min_together: int = 1,
    min_lift: float = 0.0,
    block: int = BLOCK,
) -> DataFrame:
    """(kind, item_a, item_b, n_ab, n_a, n_b, n, lift, conviction) of pairs item_a < item_b.

    n is the number of baskets of the kind with at least one item, n_a of those with the
    item, n_ab of those with both; lift = n_ab * n / (n_a * n_b); conviction of a -> b is
    (1 - n_b / n) / (1 - n_ab / n_a), null where a is never without b. Rows with a null
    kind, basket or item are left out and an item counts once a basket. Pairs with n_ab <
    min_together or lift < min_lift are left out. An empty table gives no row.

    Items that no such pair can hold are dropped first: those in under min_together
    baskets and, as lift is at most n / n_a, those in more than n / min_lift. Hot baskets are
    cut into blocks, so that no task holds more than two blocks of one.
    """
    clean = rows.select(F.col(kind).alias("kind"), F.col(basket).alias("basket"), F.col(item).alias("item")).where(
        "kind is not null and basket is not null and item is not null"
    )
    once = written(clean.distinct())
    total = F.broadcast(  # a row per kind
        once.select("kind", "basket").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    )
    counted = once.groupBy("kind", "item").agg(F.count(F.lit(1)).alias("n_item"))
    useful = counted.join(total, "kind").where(
        (F.col("n_item") >= min_together) & (F.col("n_item") * F.lit(float(min_lift)) <= F.col("n"))
    )
    seed = 0
    while True:
        keyed = written(useful.withColumn("id", F.xxhash64(F.lit(seed), "item")))
        clash = keyed.groupBy("kind", "id").count().where("count > 1")
        if clash.isEmpty():
            break
        seed += 1
    placed = once.join(keyed.select("kind", "item", "id"), ["kind", "item"]).select("kind", "basket", "id")
    pairs = met_pairs(placed, ["kind", "basket"], "id", ["kind"], block)
    met = pairs.select("kind", F.col("item_i").alias("a"), F.col("item_j").alias("b"), F.col("n_ij").alias("n_ab")).where(F.col("n_ab") >= min_together)
    left = keyed.select("kind", F.col("id").alias("a"), F.col("item").alias("left"), F.col("n_item").alias("n_left"), "n")
    right = keyed.select("kind", F.col("id").alias("b"), F.col("item").alias("right"), F.col("n_item").alias("n_right"))
    scored = met.join(left, ["kind", "a"]).join(right, ["kind", "b"])
    first = F.col("left") < F.col("right")
    n_a = F.when(first, F.col("n_left")).otherwise(F.col("n_right"))
    n_b = F.when(first, F.col("n_right")).otherwise(F.col("n_left"))
    named = scored.select(
        "kind",
        F.least("left", "right").alias("item_a"),
        F.greatest("left", "right").alias("item_b"),
        "n_ab",
        n_a.alias("n_a"),
        n_b.alias("n_b"),
        "n",
        (F.col("n_ab") * F.col("n") / (F.col("n_left") * F.col("n_right"))).alias("lift"),
    )
    rest = 1 - F.col("n_ab") / F.col("n_a")
    # whole numbers on both sides: a lift of just min_lift is not lost to rounding
    enough = F.col("n_ab") * F.col("n") >= F.col("n_a") * F.col("n_b") * F.lit(min_lift)
    return named.where(enough).withColumn(
        "conviction", F.when(F.col("n_ab") < F.col("n_a"), (1 - F.col("n_b") / F.col("n")) / rest)
    )
