import pytest

from linkloom.operators.packed import split_packed

VALUES = ["role", "company", "duration"]
CASES = {
    "plain": ("(a##b##1 year),(c##d##2004-2009)", [(1, "a", "b", "1 year"), (2, "c", "d", "2004-2009")]),
    "two values": ("(a##b)", [(1, "a", "b", "")]),
    "one value": ("(a)", [(1, "a", "", "")]),
    "empty entries": ("(a##b##5),,(##d##5),()", [(1, "a", "b", "5"), (2, "", "d", "5")]),
    "semicolons and other brackets": ("[a~b~5];[c~d~since 1998]|", [(1, "a", "b", "5"), (2, "c", "d", "since 1998")]),
    "mixed record delimiters": ("(a##b##5); (c##d##5)|(e##f##5)", [(1, "a", "b", "5"), (2, "c", "d", "5"), (3, "e", "f", "5")]),
    "nested brackets": ("(a (acting)##b (1985) Ltd.##5)", [(1, "a (acting)", "b (1985) Ltd.", "5")]),
    "quoted": ('"Head, Audit"##b##"7 yrs, part time",c##d##5', [(1, "Head, Audit", "b", "7 yrs, part time"), (2, "c", "d", "5")]),
    "doubled quotes": ('"יו""ר, ועדה"##b##5', [(1, 'יו"ר, ועדה', "b", "5")]),
    "inner quote is no quoting": ('(יו"ר, ועדה##x בע"מ##5),(c##d##5)', [(1, 'יו"ר, ועדה', 'x בע"מ', "5"), (2, "c", "d", "5")]),
    "escaped": ("Head\\, Audit~b~5, c~d~5", [(1, "Head, Audit", "b", "5"), (2, "c", "d", "5")]),
    "lines": ("(a::b::5)\n\n(c::d::)", [(1, "a", "b", "5"), (2, "c", "d", "")]),
    "quoted after a line end": ("a##b##\n“c; d”##e##5", [(1, "a", "b", ""), (2, "c; d", "e", "5")]),
    "single hash with empty company": ("(a##2004-2009),(c#d#5)", [(1, "a", "", "2004-2009"), (2, "c", "d", "5")]),
    "year in a company": ("(a##b (2003) Ltd.)", [(1, "a", "b (2003) Ltd.", "")]),
    "trailing delimiter": ("a##b##since 1998;", [(1, "a", "b", "since 1998")]),
    "null": (None, []),
    "blank": ("  ", []),
    "empty": ("", []),
    "dash": (" – ", []),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, text, "x") for name, (text, _) in CASES.items()]
    df = spark.createDataFrame(rows, "name string, packed string, role string")
    got = {}
    for r in split_packed(df, "packed", VALUES).collect():
        got.setdefault(r["name"], []).append((r["pos"], r["role"], r["company"], r["duration"]))
    return got


@pytest.mark.parametrize("name", CASES)
def test_cases(found, name):
    assert sorted(found.get(name, [])) == CASES[name][1]


def test_empty_table_long_field_and_repeats(spark):
    empty = spark.createDataFrame([], "id long, packed string")
    assert split_packed(empty, "packed", VALUES).columns == ["id", "pos", *VALUES]
    assert split_packed(empty, "packed", VALUES).count() == 0
    long = ",".join(f"(r{k}##c##5)" for k in range(3000))
    rows = spark.createDataFrame([(1, long), (1, long)], "id long, packed string")
    assert split_packed(rows, "packed", VALUES).count() == 6000
