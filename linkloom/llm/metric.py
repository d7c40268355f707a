"""Keys within a few edits of each other, found by strings that such keys must share.

An edit is an insertion, deletion, substitution or swap of neighbouring letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys longer than this share parts, shorter ones what deletions leave.
LONG = 24


def _deletions(key: str, most: int) -> set[str]:
    found = layer = {key}
    for _ in range(most):
        layer = {w[:k] + w[k + 1 :] for w in layer for k in range(len(w))}
        found = found | layer
    return found


def _parts(n: int, reach: int) -> list[tuple[int, int]]:
    """2 reach + 1 parts of a key of length n: as an edit touches at most two, one is left whole."""
    many = 2 * reach + 1
    cuts = [n * k // many for k in range(many + 1)]
    return list(zip(cuts, cuts[1:]))


def signatures(key: str, probing: bool, reach: int) -> set[str]:
    """Strings, one of which two keys within reach edits share, the one probing, the other not."""
    found = _deletions(key, reach) if len(key) <= LONG else set()
    if len(key) > LONG - reach:
        lengths = range(len(key) - reach, len(key) + reach + 1) if probing else [len(key)]
        for n in lengths:
            for k, (begin, end) in enumerate(_parts(n, reach)):
                for shift in range(-reach, reach + 1) if probing else [0]:
                    if begin + shift >= 0:
                        found.add(f"{n}/{k}/{key[begin + shift : end + shift]}")
    return found


def signed(keys: DataFrame, probing: bool, reach: int) -> DataFrame:
    """(space, key, signature) of rows of space and key."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [sorted(signatures(k, probing, reach)) for k in batch["key"]]
            yield pd.DataFrame({"space": batch["space"], "key": batch["key"], "signature": made}).explode("signature")

    return keys.select("space", "key").mapInPandas(sign, "space string, key string, signature string")


def edits(a: str, b: str) -> Column:
    """The Levenshtein distance of two columns, but 1 if the swap of two neighbouring letters is all."""
    far = F.levenshtein(a, b)
    places = F.sequence(F.lit(1), F.length(a))
    letter = lambda c, k: F.substring(c, k, F.lit(1))
    differ = F.filter(places, lambda k: letter(F.col(a), k) != letter(F.col(b), k))
    x, y = F.get(differ, F.lit(0)), F.get(differ, F.lit(1))
    swapped = (F.size(differ) == 2) & (y == x + 1) & (letter(F.col(a), x) == letter(F.col(b), y)) & (letter(F.col(a), y) == letter(F.col(b), x))
    return F.when((far == 2) & (F.length(a) == F.length(b)) & swapped, 1).otherwise(far)


def within(probes: DataFrame, of_others: DataFrame, reach: int) -> DataFrame:
    """(space, key, other, d) of signed keys within reach edits; both sides are tables of signed()."""
    others = of_others.withColumnRenamed("key", "other")
    # signatures are many more than the keys by whose size the planner would broadcast them
    met = probes.hint("merge").join(others, ["space", "signature"]).select("space", "key", "other").distinct()
    return met.withColumn("d", edits("key", "other")).where(F.col("d") <= reach)
