import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.functions.text import mapped_type
from linkloom.operators import appointments, entities, graph, reconcile
from linkloom.sources import files
from linkloom.streaming import supports


def test_entity_database_first_wins(spark, rows_of):
    one = spark.createDataFrame([(1, "A", "municipality"), (None, "X", "x")], "id long, name string, kind string")
    two = spark.createDataFrame([(1, "B"), (2, "C")], "Association_Number long, Association_Name string")
    three = spark.createDataFrame(
        [(2, "D", "TRUE", None), (3, "E", "FALSE", "true"), (4, "F", None, None)],
        "id long, company_name string, company_is_municipal string, company_is_government string",
    )
    found = entities.entity_database([entities.registry(one, 0), entities.registry(two, 1, "association"), entities.registry(three, 2)])
    assert rows_of(found) == [(1, "municipality", "A", ""), (2, "association", "C", ""), (3, "government", "E", ""), (4, "private", "F", "")]


def test_links(spark):
    register = spark.createDataFrame(
        [(1, "private", "Foo Metals Ltd", None), (2, "private", "Foo", "Foo"), (3, "ministry", "משרד אב", "Ministry of Ab"), (4, "x", "Food", None)],
        "id long, type string, name string, name_eng string",
    )
    typed = spark.createDataFrame([("foo",), ("משרד אב",), ("Ministry of Ab",), ("a.b(",), ("old",), (None,), ("",)], "org_name string")
    over = spark.createDataFrame([("old", "nowhere")], "name string, official_name string")
    found = {r["org_name"]: r for r in entities.link_entities(typed, register, mapped_type(F.col("sub_type"), {"private": "company"}), over).collect()}
    assert (found["foo"]["id"], found["foo"]["type"], found["foo"]["score"]) == (2, "company", 100.0)
    assert found["משרד אב"]["id"] == found["Ministry of Ab"]["id"] == 3
    assert (found["a.b("]["id"], found["a.b("]["type"], found["a.b("]["score"]) == (-1, "other", float("-inf"))
    assert (found["old"]["id"], found["old"]["type"], found["old"]["score"]) == (-1, "company", float("inf"))
    assert None not in found and found[""]["id"] == -1


def test_nearest_names_against_brute_force(spark):
    from linkloom.functions.similarity import plain_ratio

    known = ["Alpha Metals Ltd.", "Alpha Metal Ltd.", "Beta", "Betas", "Gamma Trading Company", "בטא", "ab", "a", "Sara Oz", "Carmela Barr", "Carmel Bar Co"]
    wanted = ["Alpha Metals Ltd", "Beta", "Bet", "Gama Trading Companyy", "nothing alike", "בטאa", "ab", "", None, "Sarah Oz", "Carmelia Bar", "Bets"]
    for least in (60, 85):
        found = appointments.nearest_names(
            spark.createDataFrame([(w,) for w in wanted], "prior_company string"),
            spark.createDataFrame([(k, k) for k in known], "organization string, term string"),
            least,
        )
        got = {r["prior_company"]: (r["best_org_match"], r["best_org_match_score"]) for r in found.collect()}
        want = {}
        for w in filter(None, wanted):
            best = min(((-plain_ratio(w, k), k) for k in known))
            if -best[0] >= least:
                want[w] = (best[1], -best[0])
        assert got == want


def test_doors_keep_unknown_types(spark, rows_of):
    jobs = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, None)], "id long, prior_company string")
    matches = spark.createDataFrame([("A", "a", "a", 90), ("B", "B", "b", 95), ("C", "c", "c", 90)], "prior_company string, best_org_match string, best_term_match string, best_org_match_score int")
    types = spark.createDataFrame([("a", "company"), ("B", "government")], "org_name string, type string")
    assert rows_of(appointments.revolving_doors(jobs, matches, types), "id", "type") == [(2, "government"), (3, None)]
    assert rows_of(appointments.revolving_doors(jobs, matches, types, strict=True), "id") == [(2,)]


def test_reconciliation(spark, rows_of):
    base = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    one = spark.createDataFrame([(1, "p"), (1, "a"), (None, "z")], "k long, v string")
    two = spark.createDataFrame([(1, "q"), (2, "r")], "k long, v string")
    assert rows_of(reconcile.with_fallback(base, "k", one, two, ["v"])) == [(1, "a", True), (2, "r", False), (3, None, False)]
    assert tuple(reconcile.set_comparison(one, two, "k").collect()[0]) == (False, 1, 2, 0, 1, 2, 1)
    texts = spark.createDataFrame([("foo bar foo bar",), ("foobar",), (None,)], "t string")
    terms = spark.createDataFrame([("foo bar", 1), ("none", 2)], "term string, positive_count long")
    assert rows_of(reconcile.discovery_ratio(texts, "t", terms)) == [("foo bar", 1, 2, 0.5), ("none", 2, 0, None)]
    names = spark.createDataFrame([("Foo Bar",), (None,), ("bar foo bar",), ("zzz",)], "n string")
    found = reconcile.gazetteer_mentions(texts.withColumn("k", F.lit(1)), "k", "t", names)
    assert rows_of(found) == [("Foo Bar", 1), ("bar foo bar", 1)]


TRIANGLES = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "x"), ("x", "y"), ("y", "z"), ("x", "z")]


def test_bridge_is_the_bottleneck(spark):
    found = graph.bottlenecks(spark.createDataFrame([*TRIANGLES, ("p", "q")], "a string, b string"), "a", "b").collect()
    assert [(r["term1"], r["term2"]) for r in found] == [("c", "x")]
    assert found[0]["betweenness"] == pytest.approx(18 / 30)


def test_large_components_are_followed_in_rounds(spark):
    rng = np.random.default_rng(5)
    graphs = [*TRIANGLES, *[(f"k{k}", f"k{k + 1}") for k in range(7)], *[(f"r{i}", f"r{j}") for i, j in rng.integers(0, 12, (20, 2)) if i != j]]
    df = spark.createDataFrame(graphs, "a string, b string")
    exact = {r["set_id"]: r for r in graph.bottlenecks(df, "a", "b").collect()}
    rounds = {r["set_id"]: r for r in graph.bottlenecks(df, "a", "b", exact_edges=0, sources=100).collect()}
    assert exact.keys() == rounds.keys() and len(exact) >= 3
    for k, r in exact.items():
        assert (r["term1"], r["term2"]) == (rounds[k]["term1"], rounds[k]["term2"])
        assert rounds[k]["betweenness"] == pytest.approx(r["betweenness"])
        assert r["connectivity"] - 1e-9 <= rounds[k]["connectivity"] <= r["connectivity"] + 0.02
    few = graph.bottlenecks(df, "a", "b", exact_edges=0, sources=3).collect()
    assert len(few) == len(exact) and all(r["term1"] is not None for r in few)


def test_two_triangles_are_two_clusters(spark):
    pairs = spark.createDataFrame([(i, j, 0.05 if (i, j) == ("c", "x") else 1.0) for i, j in TRIANGLES], "item_i string, item_j string, score double")
    got = {r["item"]: r["cluster"] for r in graph.spectral_clusters(pairs, 2).collect()}
    assert got == {"a": 0, "b": 0, "c": 0, "x": 1, "y": 1, "z": 1}
    assert graph.spectral_clusters(pairs.where("1 = 0"), 2).count() == 0
    assert graph.spectral_clusters(pairs.withColumn("score", F.lit(-1.0)), 2).count() == 0
    assert graph.spectral_clusters(pairs.limit(1), 5).count() == 2


def test_leading_vectors_are_those_of_the_matrix(spark):
    rng = np.random.default_rng(3)
    n = 24
    a = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1, n):
            a[i, j] = a[j, i] = rng.random() if i % 3 == j % 3 else 0.05 * rng.random()
    rows = [(f"{min(i, j):02}", f"{max(i, j):02}", float(a[i, j])) for i in range(n) for j in range(i + 1, n)]
    found = graph.leading_vectors(spark.createDataFrame(rows, "item_i string, item_j string, score double"), 3).orderBy("item").collect()
    v = np.array([r["v"] for r in found])
    scale = 1 / np.sqrt(a.sum(0))
    exact = np.linalg.eigh(scale[:, None] * a * scale[None, :])[1][:, -3:]
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-6)
    assert np.allclose(v @ v.T, exact @ exact.T, atol=1e-2)


def test_co_clusters(spark):
    pairs = spark.createDataFrame(
        [("c1", "g1", 1.0), ("c2", "g1", 1.0), ("c3", "g2", 1.0), ("c4", "g2", 1.0), ("c2", "g2", 0.01), ("c1", "o", 1.0)],
        "item_i string, item_j string, score double",
    )
    kinds = [(f"c{k}", "company") for k in range(1, 5)] + [("g1", "government"), ("g2", "government"), ("o", "other")]
    got = {r["item"]: r["cluster"] for r in graph.co_clusters(pairs, spark.createDataFrame(kinds, "item string, sector string"), 2).collect()}
    assert got["c1"] == got["c2"] == got["g1"] != got["c3"] == got["c4"] == got["g2"]
    assert got["o"] == 2


def test_k_means(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.normal(10 * (k % 2), 0.1, 3)]) for k in range(20)]
    found = graph.k_means(spark.createDataFrame([*rows, (99, None)], "id long, v array<float>"), "id", "v", 2).collect()
    assert len(found) == 20 and len({(r["id"] % 2, r["cluster"]) for r in found}) == 2
    assert max(r["distance"] for r in found) < 1


def test_files(spark, tmp_path, rows_of):
    docs = spark.createDataFrame([("u1", "text one\nmore"), ("u2", "")], "url string, text string")
    files.append_documents(docs.coalesce(1), f"{tmp_path}/log", "<<END>>", "<<URL>>")
    assert rows_of(files.read_documents(spark, f"{tmp_path}/log", "<<END>>", "<<URL>>")) == [("u1", "text one\nmore"), ("u2", "")]
    rows = spark.createDataFrame([('a "q", b', "01/02/2004"), ("x\ny", "03/04/2005")], "t string, d string")
    files.write_csv(rows, f"{tmp_path}/csv")
    assert rows_of(files.read_csv(spark, f"{tmp_path}/csv")) == sorted([('a "q", b', "01/02/2004"), ("x\ny", "03/04/2005")], key=repr)
    files.write_by_year(rows, f"{tmp_path}/years", "d")
    assert rows_of(spark.read.parquet(f"{tmp_path}/years"), "year") == [(2004,), (2005,)]
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "17.csv").write_text("header,text\nh,t\n")
    assert rows_of(files.read_named_files(spark, f"{tmp_path}/in", "header string, text string")) == [("h", "t", "17")]
    (tmp_path / "words.txt").write_text("a\n\n b \na\n")
    assert rows_of(files.read_lexicon(spark, f"{tmp_path}/words.txt")) == [("a",), ("b",)]
    (tmp_path / "pairs.csv").write_text('a,b\n"c, d",e\n')
    assert rows_of(files.read_pairs(spark, f"{tmp_path}/pairs.csv")) == [("a", "b"), ("c, d", "e")]


def test_streamed_counts(spark, tmp_path, rows_of):
    batches = [[(1, "a"), (1, "b")], [(2, "a"), (2, "b"), (2, "c")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k long, v string").parquet(f"{tmp_path}/in")
        supports.keep_pair_counts(stream, "k", "v", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert rows_of(supports.running_counts(spark, f"{tmp_path}/out")) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
