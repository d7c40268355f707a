"""Similarity of strings by matching blocks (Ratcliff-Obershelp), from 0 to 100, as Arrow functions.

The measure depends on the order of its arguments: pairs are given with the lesser string first.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _percent(share: float) -> int:
    return int(round(100 * share))


@lru_cache(maxsize=1 << 16)
def plain_ratio(a: str, b: str) -> int:
    """2 M / (|a| + |b|), M the characters in matching blocks; 0 for an empty string."""
    return _percent(SequenceMatcher(None, a, b).ratio()) if a and b else 0


def best_window_ratio(a: str, b: str) -> int:
    """The best ratio of the shorter string with a window of its length in the longer one, at matching blocks."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0
    best = 0.0
    for block in SequenceMatcher(None, short, long).get_matching_blocks():
        begin = max(0, block.b - block.a)
        share = SequenceMatcher(None, short, long[begin : begin + len(short)]).ratio()
        if share > 0.995:
            return 100
        best = max(best, share)
    return _percent(best)


def sorted_tokens(text: str) -> str:
    """The words of a text in lower case and sorted order; characters 128-255 are dropped before."""
    kept = "".join(ch for ch in text if not 127 < ord(ch) < 256)
    return " ".join(sorted(re.sub(r"\W", " ", kept).lower().split()))


def token_sort_ratio(a: str, b: str) -> int:
    return plain_ratio(sorted_tokens(a), sorted_tokens(b))


def partial_token_sort_ratio(a: str, b: str) -> int:
    return best_window_ratio(sorted_tokens(a), sorted_tokens(b))


def spaced_ratio(a: str, b: str) -> float:
    """The ratio from 0 to 1 with spaces taken as junk."""
    return SequenceMatcher(lambda ch: ch == " ", a, b).ratio()


def _over(function, kind: str):
    @F.pandas_udf(kind)
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b)], dtype="object")

    return scored


def ratio(a: Column, b: Column) -> Column:
    """Null if either side is null."""
    return _over(plain_ratio, "int")(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    return _over(best_window_ratio, "int")(a, b)


def token_sort(a: Column, b: Column) -> Column:
    return _over(token_sort_ratio, "int")(a, b)


def four_scores(a: Column, b: Column) -> Column:
    """A struct of ratio, fratio, pfratio and ptfratio; nulls if either side is null."""

    @F.pandas_udf("ratio double, fratio int, pfratio int, ptfratio int")
    def scored(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [
            (None,) * 4
            if x is None or y is None
            else (spaced_ratio(x, y), plain_ratio(x, y), best_window_ratio(x, y), partial_token_sort_ratio(x, y))
            for x, y in zip(a, b)
        ]
        return pd.DataFrame(rows, columns=["ratio", "fratio", "pfratio", "ptfratio"])

    return scored(a, b)


def numbered_characters(text: Column) -> Column:
    """The characters of a text, each with how often it has occurred so far: the multiset as a set."""
    characters = F.split(text, "")
    return F.transform(
        characters,
        lambda ch, k: F.concat(ch, F.size(F.filter(F.slice(characters, F.lit(1), k), lambda x: x == ch)).cast("string")),
    )


def may_reach(a_characters: Column, b_characters: Column, threshold: int) -> Column:
    """False only where the ratio of two texts is surely below the threshold; of their numbered_characters.

    Twice the common multiset of characters over the sum of the lengths bounds the ratio from above.
    """
    common = F.size(F.array_intersect(a_characters, b_characters))
    return 200 * common >= (threshold - 0.5) * (F.size(a_characters) + F.size(b_characters))
