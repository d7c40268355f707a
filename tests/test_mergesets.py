import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.functions import similarity
from linkloom.operators import mergesets


def groups(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in parent)


def test_merge_sets(spark, rows_of):
    rng = random.Random(1)
    chain = [(f"n{k:03}", f"n{k + 1:03}") for k in range(200)]
    star = [("hub", f"s{k}") for k in range(50)]
    loose = [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(50)]
    pairs = [*chain, *star, *loose, ("x", "x"), (None, "y"), ("z", None), ("hub", "s1"), ("s1", "hub")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert rows_of(mergesets.merge_sets(df, "a", "b")) == groups(pairs)
    assert mergesets.merge_sets(df.where("1 = 0"), "a", "b").count() == 0


def test_bag_difference_takes_one_occurrence(spark, rows_of):
    schema = "term1 string, term2 string"
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("e", "f")], schema)
    removed = spark.createDataFrame([("b", "a"), ("b", "a"), ('"d"', "c")], schema)
    assert rows_of(mergesets.pair_bag_difference(pairs, removed)) == [("a", "b"), ("e", "f")]


def test_overlap(spark, rows_of):
    guests = spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "x"), ("q", "y"), ("r", "y"), (None, "x"), ("p", None)], "p string, c string")
    assert rows_of(mergesets.set_overlap(guests, "p", "c")) == [("x", "y", 2 / 3, 2, 3)]


def test_indicative_names_exclude_lobbyists(spark):
    guests = spark.createDataFrame([("p", "x"), ("q", "x"), ("q", "y"), (None, "z")], "p string, c string")
    lobby = spark.createDataFrame([("p",)], "p string")
    flags = {r["p"]: r["is_indicative_name"] for r in mergesets.indicative_persons(guests, "p", "c", 1, lobby).collect()}
    assert flags == {"p": False, "q": False, None: True}


def test_canonical_terms_and_rollups(spark, rows_of):
    sets = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")], "member string, set_id string")
    counts = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2), ("d", 2), ("e", 5)], "name string, n long")
    terms = mergesets.commonest_member(sets, counts)
    assert rows_of(terms) == [("a", "b"), ("c", "c")]
    assert rows_of(mergesets.rolled_up_counts(counts, sets, terms)) == [("b", 4), ("c", 4), ("e", 5)]
    pairs = spark.createDataFrame([("a", "b", 9), ("a", "c", 1), ("b", "d", 2)], "item_i string, item_j string, n long")
    assert rows_of(mergesets.rolled_up_pairs(pairs, sets, terms)) == [("b", "c", 3)]
    scores = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, score double")
    assert rows_of(mergesets.most_similar_member(sets, scores)) == [("a", "a"), ("c", "c")]


@pytest.mark.parametrize(
    ("a", "b", "want"), [("kitten", "sitting", 62), ("blue anvil", "blue widget", 57), ("abcd", "bcde", 75), ("tide", "diet", 25), ("diet", "tide", 50), ("", "x", 0)]
)
def test_ratio_vectors(a, b, want):
    assert similarity.plain_ratio(a, b) == want


def test_other_ratios():
    assert similarity.token_sort_ratio("Blue  Anvil", "anvil, blue!") == 100
    assert similarity.best_window_ratio("anvil", "the blue anvil works") == 100
    assert similarity.partial_token_sort_ratio("", "x") == 0


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12), st.integers(1, 100))
def test_bound_loses_no_pair(a, b, threshold):
    common = sum(min(a.count(ch), b.count(ch)) for ch in set(a))
    if a and b and similarity.plain_ratio(a, b) >= threshold:
        assert 200 * common >= (threshold - 0.5) * (len(a) + len(b))


def test_bound_in_spark(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("aab", "aba", True), ("abc", "xyz", False)], "a string, b string, want boolean")
    ok = similarity.may_reach(similarity.numbered_characters(F.col("a")), similarity.numbered_characters(F.col("b")), 80)
    assert all(r["want"] == r["got"] for r in df.withColumn("got", ok).collect())
