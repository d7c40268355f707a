"""Filling containers of a fixed capacity with items, splitting only items that exceed it.

Patterns of a few item lengths that fill a container are enumerated, their repeat counts
fitted to the histogram of the lengths by non-negative least squares and rounded; items are dealt to the
containers of the patterns, and what the patterns leave over is packed best-fit in portions.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.runtime import written

#: Length classes of a container, and the least class and the most items of a pattern.
CLASSES = 128
LEAST_CLASS = 10
MOST_ITEMS = 4

#: Items that one task packs together.
PORTION = 50_000


def patterns(classes: int = CLASSES, least: int = LEAST_CLASS, most: int = MOST_ITEMS) -> list[tuple[int, ...]]:
    """Lists of up to `most` classes from `least` on, in descending order, that add up to `classes`."""
    found: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], rest: int) -> None:
        if rest == 0:
            found.append(head)
        elif len(head) < most:
            for part in range(min(rest, head[-1] if head else rest), least - 1, -1):
                grow((*head, part), rest - part)

    grow((), classes)
    return found


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method; at most as many x are positive as a has rows."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= tolerance * scale:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            active[at[(x[at] <= 1e-12 * scale) & low]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def fitted(histogram: dict[int, int], found: list[tuple[int, ...]], classes: int = CLASSES, power: float = 1.0) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use no class more often than the histogram has it."""
    b = np.zeros(classes + 1)
    for size_class, count in histogram.items():
        b[size_class] = count
    usable = [p for p in found if all(b[c] for c in p)]
    if not usable:
        return []
    a = np.zeros((classes + 1, len(usable)))
    for k, pattern in enumerate(usable):
        for c in pattern:
            a[c, k] += 1
    weight = np.arange(classes + 1) ** power  # long items are harder to place later
    x = np.floor(non_negative_least_squares(weight[:, None] * a, weight * b) + 0.5).astype(np.int64)
    left = b - a @ x
    order = np.argsort(-x, kind="stable")
    for k in order:  # rounding and the fit may use too many of a class
        while x[k] > 0 and (short := max((-left[c] / a[c, k] for c in set(usable[k])), default=0)) > 0:
            back = min(int(x[k]), int(np.ceil(short)))
            x[k] -= back
            left += back * a[:, k]
    for k in order:  # and may leave enough for another round
        more = int(min(left[c] // a[c, k] for c in set(usable[k])))
        if more > 0:
            x[k] += more
            left -= more * a[:, k]
    return [(usable[k], int(x[k])) for k in np.flatnonzero(x)]


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item: largest first, each into the fullest container that still holds it."""
    container = np.zeros(len(sizes), np.int64)
    room: list[tuple[int, int]] = []  # sorted (room left, container)
    many = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        at = bisect.bisect_left(room, (size, -1))
        if at == len(room):
            left, number = capacity, many
            many += 1
        else:
            left, number = room.pop(at)
        container[k] = number
        if left > size:
            bisect.insort(room, (left - size, number))
    return container


def packed(items: DataFrame, id_column: str, size_column: str, capacity: int) -> DataFrame:
    """(id_column, piece, start, n, container): where each item, or piece of an item, goes.

    Items no larger than the capacity come out whole, as piece 0. A larger one is cut into
    pieces of the whole capacity, each a container of its own, and a rest that is packed like an
    item; start is where the piece begins in the item. No container holds more than the
    capacity. Items of size 0 or null need no container: they come out with n 0 and a null container. Ids may
    repeat and may be null. An empty table gives no row. Other columns are ignored.

    To the driver come only the histogram of `CLASSES` length classes; no task holds
    more than about `PORTION` items of one class, however common a length is.
    """
    size = F.coalesce(F.col(size_column).cast("long"), F.lit(0))
    rows = items.select(F.col(id_column).alias("id"), size.alias("size"))
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)))
    cut = rows.select("id", "size", F.explode(pieces).alias("piece")).select(
        "id",
        "piece",
        (F.col("piece") * capacity).alias("start"),
        F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("n"),
    )
    cut = written(cut.withColumn("key", F.monotonically_increasing_id()))
    none = cut.where("n <= 0").select("id", "piece", "start", F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("container"))
    full = cut.where(F.col("n") == capacity).select(
        "id", "piece", "start", "n", F.concat(F.lit("full-"), F.col("key")).alias("container")
    )
    unit = max(1, -(-capacity // CLASSES))
    classes = -(-capacity // unit)
    open_ = cut.where((F.col("n") > 0) & (F.col("n") < capacity)).withColumn("c", F.ceil(F.col("n") / unit).cast("int"))
    histogram = {r["c"]: r["count"] for r in open_.groupBy("c").count().collect()}  # a row per class
    # a container of `classes` classes may lack the last unit if the unit doesn't divide the capacity
    whole = capacity // unit
    plan = fitted(histogram, patterns(whole, max(1, LEAST_CLASS * whole // CLASSES)), classes)
    ranges, used = [], {}
    for number, (pattern, repeats) in enumerate(plan):
        for c in sorted(set(pattern)):
            begin = used.get(c, 0)
            used[c] = begin + repeats * pattern.count(c)
            ranges.append((c, begin, used[c], number, repeats))
    spark = items.sparkSession
    schema = "c int, low long, high long, pattern int, repeats long"
    deal = F.broadcast(spark.createDataFrame(ranges, schema))  # at most MOST_ITEMS rows per fitted pattern
    salts = max(1, -(-max(histogram.values(), default=0) // PORTION))
    salted = open_.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    before = Window.partitionBy("c").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("c", "salt").count().select(
        "c", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("c", "salt").orderBy("key")
    ranked = salted.withColumn("at", F.row_number().over(within) - 1).join(offsets, ["c", "salt"])
    ranked = ranked.select("id", "piece", "start", "n", "key", "c", (F.col("at") + F.col("offset")).alias("k"))
    dealt = ranked.join(deal, (ranked.c == deal.c) & (ranked.k >= deal.low) & (ranked.k < deal.high), "left").select(
        "id",
        "piece",
        "start",
        "n",
        "key",
        F.concat(F.lit("pattern-"), "pattern", F.lit("-"), (F.col("k") - F.col("low")) % F.col("repeats")).alias("container"),
    )
    dealt = written(dealt)
    placed = dealt.where("container is not null").drop("key")
    rest = dealt.where("container is null").drop("container")
    portions = max(1, -(-rest.count() // PORTION))

    def fit(pieces_of_portion: pd.DataFrame) -> pd.DataFrame:
        number = best_fit(pieces_of_portion["n"].to_numpy(), capacity)
        portion = pieces_of_portion["portion"].iloc[0]
        pieces_of_portion["container"] = [f"rest-{portion}-{k}" for k in number]
        return pieces_of_portion[["id", "piece", "start", "n", "container"]]

    packed_rest = (
        rest.withColumn("portion", F.pmod(F.xxhash64("key"), F.lit(portions)))
        .groupBy("portion")
        .applyInPandas(fit, placed.schema)
    )
    whole_result = placed.unionByName(packed_rest).unionByName(full).unionByName(none)
    return whole_result.withColumnRenamed("id", id_column)
