import unicodedata

import pytest

from linkloom import queries

NAMES = [(1, "Foo Bar", None), (2, "עיריית אבג", "Municipality of Abg"), (3, 'אבג מדיה בע"מ', "Abg 7 Média"), (4, None, None), (5, "Foo", "...")]
TEXTS = [(1, "FOO bar, foo."), (2, "ביקר בעיריית אבג.\nעיריית אבג"), (3, 'אבג מדיה בע"מ – foo'), (4, None), (5, ""), (6, "foobar 7"), (7, "Mr. Foo Bar\nאבג"), (8, "Mr Prof. X")]
TYPED = ["foo", "אבג", "abg 7", "MÉDIA", 'בע"מ', "oo", None, "of Abg"]
BASKETS = ["Foo Bar", "Foo Bar", "עיריית אבג", "אבג", "Abg 7", "Foo", None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    for name, rows, schema in (
        ("entity_database", NAMES, "id long, name string, name_eng string"),
        ("documents", [(k, t, "he") for k, t in TEXTS], "doc_id long, text string, lang string"),
        ("org_entity_matches", [(t,) for t in TYPED], "org_name string"),
        ("article_baskets", [(b,) for b in BASKETS], "organization string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def _words(text):
    return "".join(ch if unicodedata.category(ch)[0] in "LMN" else " " for ch in text.lower()).split()


def _inside(part, whole):
    a, b = _words(part), _words(whole)
    return bool(a) and any(b[k : k + len(a)] == a for k in range(len(b)))


def test_mentions_of_all_names_in_all_texts(spark, folder, rows_of):
    want = [(n, k) for _, n, _ in NAMES for k, t in TEXTS if n and t and _inside(n, t)]
    assert rows_of(queries.queries()["gazetteer_mentions"](spark, folder)) == sorted(want, key=repr)
    assert ("עיריית אבג", 2) in want


def test_ratios_of_all_spellings_in_all_rows(spark, folder, rows_of):
    known = [b for b in BASKETS if b]
    want = []
    for term in set(known):
        total = sum(b.count(term) for b in known if set(_words(term)) <= set(_words(b)))
        want.append((term, known.count(term), total, round(known.count(term) / total, 6)))
    assert rows_of(queries.queries()["discovery_ratio"](spark, folder)) == sorted(want, key=repr)


def test_entities_of_all_typed_names(spark, folder, rows_of):
    want = {(t, k) for t in TYPED if t for k, *names in NAMES for n in names if n and _inside(t, n)}
    assert rows_of(queries.queries()["containing_entities"](spark, folder)) == sorted(want, key=repr)
