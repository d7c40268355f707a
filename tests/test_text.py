import pytest
from pyspark.sql import functions as F

from linkloom.functions import html, text


def one(spark, value, column, **kinds):
    row = spark.createDataFrame([(value,)], "t string").select(column.alias("r")).collect()[0]["r"]
    return row


def test_leading_terms(spark):
    t = lambda v: one(spark, v, text.without_leading_terms(F.col("t"), ["חבר", "rep."]))
    assert t("חברת rep. אבג") == "אבג"
    assert t("rep. חברה") == ""
    assert t("אבג חברה") == "אבג חברה"
    assert t(None) is None


def test_split_off_terms(spark):
    found = one(spark, "Foo (lobbyist for) Bar", text.split_off_terms(F.col("t"), ["lobby", "(lobbyist for)"]))
    assert tuple(found) == ("(lobbyist for)", "Foo  Bar")
    assert tuple(one(spark, "Foo", text.split_off_terms(F.col("t"), ["x"]))) == ("", "Foo")


@pytest.mark.parametrize(
    ("row", "want"),
    [("a b - t, org", ["a b", "t", "org"]), ("org, x - name", ["name", "org", "x"]), ("a – b", ["a", "b"]), ("single", ["single"])],
)
def test_row_parts(spark, row, want):
    assert one(spark, row, text.row_parts(F.col("t"))) == want


def test_guest_rows(spark, rows_of):
    lines = ["Dana Levi - head - rep. Foo", "Foo, Bar - Dana", "Note: a - b", "nobody here - x", "Dana - rep. "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "id long, line string")
    found = text.guest_rows(df, "line", ["Dana"], ["Levi"], [], ["rep."], [])
    assert rows_of(found) == [(0, "Dana Levi", "head", "Foo", "rep. Foo"), (1, "Dana", "Foo", "Bar", "Bar")]


def test_counts_and_segments(spark):
    assert one(spark, "aaaa", text.substring_count(F.col("t"), F.lit("aa"))) == 2
    assert one(spark, "aaaa", text.substring_count(F.col("t"), F.lit(""))) == 0
    assert one(spark, "x=1=22", text.last_segment(F.col("t"), "=")) == "22"
    assert one(spark, "שלום", text.display_order(F.col("t"))) == "םולש"
    assert one(spark, "the Ministry of X", text.looked_up_title(F.col("t"), "Y")) == "ministry of x"


def test_hierarchy(spark, rows_of):
    df = spark.createDataFrame([("משרד-אגף/צוות",), ("המשרד/אגף",), ("בלי",)], "name string")
    found = text.hierarchy(df, "name").select("parent", "child", "fingerprint")
    assert rows_of(found) == [("המשרד", "אגף", "משרד"), ("משרד", "אגף/צוות", "משרד")]


def test_types_days_triples(spark, rows_of):
    assert one(spark, None, text.mapped_type(F.col("t"), {"a": "company"})) == "other"
    assert one(spark, "a", text.mapped_type(F.col("t"), {"a": "company"})) == "company"
    assert [r["day"] for r in text.days_down(spark, "2020-03-01", "2020-02-27", 2).collect()] == ["20200301", "20200228"]
    assert [tuple(x) for x in one(spark, "(a##b##c),(d##e),((f##g##h))", text.triples(F.col("t")))] == [("a", "b", "c"), ("f", "g", "h")]


def test_pages(spark):
    page = "<html><head><title>no</title></head><body>a<!-- c --><br><script>no</script> <b>b</b><a href='http://x/article/1.html'>l</a><a>n</a></body></html>"
    assert one(spark, page, html.visible_text(F.col("t"))) == "a b l n"
    assert one(spark, page, html.matching_links(F.col("t"), "article")) == ["http://x/article/1.html"]
    assert one(spark, None, html.visible_text(F.col("t"))) is None
