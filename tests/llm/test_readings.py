from collections import defaultdict

from linkloom.llm import variants
from tests.llm.test_llm import REGISTER, _listed


def test_latin_cores_are_read_as_letters_and_as_consonants(spark):
    spelled = [
        "Kikifitudv Chemicals Ltd.", "Kikifitudu Chemicals Ltd.", 'גדפנל מדיה בע"מ', "Gadapenol Media Ltd.",
        "Zokadofa Metals", "Zukidefo Metals",
    ]
    df = spark.createDataFrame([(n, 5) for n in spelled], "name string, rows long")
    by = defaultdict(set)
    for r in variants.organisations(df, _listed(spark, REGISTER), ["name", "name_eng"]).collect():
        by[r["entity"]].add(r["name"])
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, [spelled[:2], spelled[2:4], spelled[4:5], spelled[5:]]))
