import math

import pytest

from linkloom.operators import baskets, rules

TINY = [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "a"), (4, "b"), (4, "d"), (4, "b"), (None, "a"), (5, None)]


@pytest.fixture
def relation(spark):
    return baskets.basket_relation(spark.createDataFrame(TINY, "k long, v string"), "k", "v")


def test_supports(relation, rows_of):
    assert rows_of(baskets.item_support(relation)) == [("a", 3, 0.75), ("b", 3, 0.75), ("c", 1, 0.25), ("d", 1, 0.25)]


@pytest.mark.parametrize("metric", baskets.METRICS)
def test_scores_against_brute_force(relation, metric):
    sets = {"a": {1, 2, 3}, "b": {1, 2, 4}, "c": {1}, "d": {4}}
    for r in baskets.frequent_pairs(relation, metric, 0.25).collect():
        i, j, n = sets[r["item_i"]], sets[r["item_j"]], 4
        lift = len(i & j) * n / (len(i) * len(j))
        chance = math.floor(math.floor(n * 0.25) / 2)
        want = {
            "jaccard": len(i & j) / len(i | j),
            "root_jaccard": len(i & j) / len(i | j),
            "pmi": math.log(lift),
            "weighted_pmi": math.log(lift * (len(i & j) - chance) / len(i & j) + chance / len(i & j)),
        }[metric]
        assert r["score"] == pytest.approx(want)


def test_normalisation_of_nothing_and_of_nothing_positive(spark, relation):
    pairs = baskets.frequent_pairs(relation, "pmi").where("1 = 0")
    assert baskets.normalized(pairs).count() == 0
    negative = spark.createDataFrame([("a", "b", -1.0)], "item_i string, item_j string, score double")
    assert baskets.normalized(negative).collect()[0]["score"] is None


def test_minimum_support_is_inclusive(relation):
    assert baskets.frequent_pairs(relation, "pmi", 0.5).select("item_i", "item_j").collect() == [("a", "b")]


def test_excluded_items_keep_the_number_of_baskets(spark, relation):
    pairs = baskets.frequent_pairs(relation, "pmi", 0.0, spark.createDataFrame([("b",)], "item string"))
    assert [(r["item_i"], r["item_j"], round(math.exp(r["score"]), 6)) for r in pairs.collect()] == [("a", "c", round(4 / 3, 6))]


def test_rules(relation, rows_of):
    found = {(r["antecedent"], r["consequent"]): r for r in rules.association_rules(relation).collect()}
    assert found["a", "b"]["confidence"] == pytest.approx(2 / 3)
    assert found["a", "b"]["lift"] == pytest.approx(8 / 9)
    assert found["a", "b"]["interest"] == pytest.approx(2 / 3 - 0.75)


def test_top_per_consequent_pads(spark):
    rows = spark.createDataFrame([("x", "g", 0.5), ("y", "g", 0.5), ("z", "h", 0.9)], "antecedent string, consequent string, interest double")
    top = {r["government"]: tuple(r)[1:] for r in rules.top_per_consequent(rows, 3).collect()}
    assert top == {"g": ("x", "y", ""), "h": ("z", "", "")}


def test_ranks_are_global(spark):
    rows = [(f"i{k:03}", "j", float(k % 17)) for k in range(200)]
    pairs = spark.createDataFrame(rows, "item_i string, item_j string, score double").repartition(5)
    want = {r[0]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    assert {r["item_i"]: r["rank"] for r in rules.ranked(pairs, "rank").collect()} == want
