import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from linkloom import queries
from linkloom.functions import html, similarity, text
from linkloom.operators import appointments, baskets, mergesets
from linkloom.plans import pipelines


@pytest.mark.parametrize("block", [2, 64])
def test_pairs_of_large_and_equal_baskets(spark, block):
    rng = random.Random(1)
    sets = {f"b{k}": {f"i{rng.randrange(12)}" for _ in range(rng.randrange(1, 9))} for k in range(30)}
    sets |= {f"same{k}": {f"i{n}" for n in range(11)} for k in range(5)} | {"wide": {f"w{n:04}" for n in range(200)}, "wide too": {f"w{n:04}" for n in range(200)}}
    rows = [(k, i) for k, v in sets.items() for i in v]
    want = Counter(p for v in sets.values() for p in itertools.combinations(sorted(v), 2))
    found = baskets.met_pairs(spark.createDataFrame(rows, "k string, item string"), ["k"], "item", block=block)
    assert {(r["item_i"], r["item_j"]): r["n_ij"] for r in found.collect()} == want


def test_one_basket_of_thousands(spark):
    rows = spark.range(3000).select(F.lit("b").alias("k"), F.col("id").cast("string").alias("item"))
    assert baskets.met_pairs(rows, ["k"], "item").count() == 3000 * 2999 // 2


def test_guests_of_protocols(spark, rows_of):
    protocols = spark.createDataFrame(
        [
            ("1", "מוזמנים:", "Dr. Dana Levi - head, Foo\nChair: x - y, z\nFoo, clerk - Dana Ben-Ari\nno guest\nX Y - z, w"), ("1", "סיום", "Dana Levi - x, y"),
            ("2", "מוזמנים", None), ("3", "guests", "Dana Levi - x, y"), ("4", ":מוזמנים", "Dana Levi\t–\thead, Bar"), (None, "מוזמנים", "Dana Levi - x, y"),
        ],
        "meeting_id string, header string, block string",
    )
    meetings = spark.createDataFrame([(1, 7, "A, b", "s", "01/02/2004", "r"), (9, 7, None, None, None, None)], "id long, committee_id long, title string, session_content string, meeting_date string, reference string")
    lexicon = spark.createDataFrame([("Dana", "first"), ("Levi", "last"), ("Dr.", "title"), ("Dana", "last"), (None, "first")], "term string, kind string")
    found = pipelines.extracted_guests(protocols, "meeting_id", "header", "block", meetings, lexicon, [], [])
    assert rows_of(found, "meeting_id", "full_name", "job_title", "company", "committee_id", "meeting_title", "year") == [
        ("1", "Dana Ben-Ari", "Foo", "clerk", 7, "A b", "2004"), ("1", "Dana Levi", "Dr. head", "Foo", 7, "A b", "2004"), ("4", "Dana Levi", "head", "Bar", None, None, None),
        (None, "Dana Levi", "x", "y", None, None, None),
    ]
    assert pipelines.extracted_guests(protocols.where("1 = 0"), "meeting_id", "header", "block", meetings, lexicon, [], []).count() == 0
    lines = spark.createDataFrame([(1, "Dana Levi - head, Foo", "kept")], "id long, line string, Company string")
    assert rows_of(pipelines.parsed_guests(lines, "line", lexicon, [], []), "id", "company") == [(1, "Foo")]


def test_scores_and_rounds_of_merging(spark, rows_of):
    names = {"Foo Ltd": "abcd", "Foo Ltd.": "abc", "Bar": "ad", "Baz": "e", "Far": "a"}
    people = [(p, c) for c, v in names.items() for p in v] + [("a", None), (None, "Bar")]
    guests = spark.createDataFrame([(k, p, c) for k, (p, c) in enumerate(people)], "id long, full_name string, company string")
    got = {(r["c1"], r["c2"]): r for r in pipelines.candidate_scores(guests, "full_name", "company").collect()}
    for c1, c2 in itertools.combinations(sorted(names), 2):
        both, either = set(names[c1]) & set(names[c2]), set(names[c1]) | set(names[c2])
        assert ((c1, c2) in got) == bool(both)
        if both:
            r = got[c1, c2]
            assert (r["iou"], r["intersection"], r["union"]) == (len(both) / len(either), len(both), len(either))
            assert (r["fratio"], r["pfratio"], r["ptfratio"]) == (similarity.plain_ratio(c1, c2), similarity.best_window_ratio(c1, c2), similarity.partial_token_sort_ratio(c1, c2))
            assert r["ratio"] == similarity.spaced_ratio(c1, c2)
    merged = pipelines.merged_by_rounds(guests, "full_name", "company", [mergesets.CONDITIONS["ratio"](), mergesets.CONDITIONS["filtered"]()])
    want = [(k, "Foo Ltd" if c == "Foo Ltd." else c) for k, (_, c) in enumerate(people)]
    assert rows_of(merged, "id", "company") == sorted(want, key=repr)
    assert pipelines.candidate_scores(guests, "full_name", "company", 1, 2).where("c1 = 'Bar' and c2 = 'Far'").count() == 0


def test_all_pairs_of_a_ratio(spark, tmp_path):
    parts = [f"{a} {b}" for a in ("blue", "cold", "old", "red") for b in ("bolt", "plate", "ring", "widget")] + ["", None, "a", "ab", "ba"]
    spark.createDataFrame([(p,) for p in parts], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r["a"], r["b"]): r["fratio"] for r in queries.queries()["fuzzy_ratio"](spark, str(tmp_path)).collect()}
    want = {(a, b): similarity.plain_ratio(a, b) for a, b in itertools.combinations(sorted(p for p in parts if p), 2)}
    assert got == {p: r for p, r in want.items() if r >= 60}
    assert ("cold bolt", "old plate") in got


def test_selected_parts_of_pages(spark):
    page = '<select id="t"><option value="a">A<option selected value="b">B</select><div class="u v"><span class="n">x &amp; y</span></div><span class="n">z</span>'
    df = spark.createDataFrame([(page,), (None,), ("<span",), ("",)], "h string")
    found = [tuple(r) for r in df.select(html.selected(F.col("h"), "option", {"value": "b"}, "value"), html.selected(F.col("h"), "span", {"class": "n"}), html.selected(F.col("h"), "p", {})).collect()]
    assert found == [("b", "x & y", None), (None, None, None), (None, None, None), (None, None, None)]


def test_last_wins_and_types_by_table(spark, rows_of):
    rows = spark.createDataFrame([("a", "z", 1), ("a", "b", 2), (None, "c", 3), ("d", None, 1)], "k string, v string, row_no long")
    assert rows_of(appointments.last_wins(rows, "k", "v")) == [("a", "b"), ("d", None)]
    assert rows_of(appointments.last_wins(rows.drop("row_no"), "k", "v")) == [("a", "z"), ("d", None)]
    types = spark.createDataFrame([("a", "company"), (None, "x")], "sub_type string, type string")
    assert rows_of(text.with_mapped_type(rows.select("k"), "k", types)) == [("a", "company"), ("a", "company"), ("d", "other"), (None, "other")]
