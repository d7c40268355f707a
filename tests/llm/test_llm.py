import base64
import itertools
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import components, copies, lexicon, linking, names, packing, sentences, together, tokens, variants


# --- copies ------------------------------------------------------------------------------------


def test_copies(spark, rows_of):
    rows = [
        (1, "m", "n", 'Foo "X" Ltd.', "Head, Water"),
        (2, "m", "n", "foo x LTD", "water - head"),
        (3, "m", "n", "Water Head", "Foo X Ltd"),
        (4, "m", "n", "Foo X Ltd", None),
        (5, "m", "n", "foo_x_ltd", None),
        (6, "m", "n", "Foo X Ltd 2", "Head, Water"),
        (7, None, "n", "Foo X Ltd", None),
        (8, "m", None, "Foo X Ltd", None),
        (9, "m", "N", "Foo X Ltd", None),
        (10, "k", "n", 'בע"מ אב', "יו\"ר"),
        (11, "k", "n", "אב בעמ", "יור"),
        (12, "k", "n", "", ""),
        (13, "k", "n", None, "..."),
        (1, "m", "n", 'Foo "X" Ltd.', "Head, Water"),
    ]
    df = spark.createDataFrame(rows, "id long, m string, n string, c string, j string").withColumnRenamed("m", "meeting")
    found = copies.formatting_copies(df, "id", ["meeting", "n"], ["c", "j"], ["j"])
    assert rows_of(found) == [(1, 2, 3), (1, 3, 3), (10, 11, 2), (12, 13, 2), (4, 5, 2)]
    # byte-identical rows are one list of ids, however far apart these are, unless they are too many for one
    spread = [(int.from_bytes(random.Random(k).randbytes(7)), "m", "n", "Foo", "Head" if k % 3 else "head") for k in range(90)]
    many = spark.createDataFrame(spread, "id long, meeting string, n string, c string, j string")
    first = min(r[0] for r in spread)
    want = sorted([(first, r[0], 90) for r in spread if r[0] != first], key=repr)
    for chunk in (1 << 16, 10):
        assert rows_of(copies.formatting_copies(many, "id", ["meeting", "n"], ["c", "j"], ["j"], chunk)) == want
    assert copies.collapsed(many, "id", ["meeting", "n"], ["c", "j"]).count() == 2
    assert copies.collapsed(many, "id", ["meeting", "n"], ["c", "j"], 10).count() > 2
    assert copies.formatting_copies(df.where("1 = 0"), "id", ["meeting", "n"], ["c", "j"]).count() == 0


# --- components --------------------------------------------------------------------------------


def _groups(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                root(x)
        if a is not None and b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return sorted(((root(x), x) for x in parent), key=repr)


@pytest.mark.parametrize("levels", [1, 8])
def test_components(spark, rows_of, levels):
    rng = random.Random(3)
    chain = [(f"c{k:04}", f"c{k + 1:04}") for k in range(150)]
    star = [("hub", f"s{k}") for k in range(60)] + [("s0", "t0"), ("t0", "t1"), ("t1", "t2")]
    loose = [(f"r{rng.randrange(50)}", f"r{rng.randrange(50)}") for _ in range(40)]
    pairs = [*chain, *star, *loose, ("x", "x"), (None, "y"), ("z", None), (None, None), ("", "e"), ("e", "")]
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a string, b string, u int")
    assert rows_of(components.components(df, "a", "b", levels)) == _groups(pairs)


def test_components_of_nothing(spark, rows_of):
    df = spark.createDataFrame([("x", "x"), (None, "y")], "a string, b string")
    assert rows_of(components.components(df, "a", "b")) == [("x", "x"), ("y", "y")]
    assert components.components(df.where("1 = 0"), "a", "b").count() == 0


# --- items together ----------------------------------------------------------------------------


@pytest.mark.parametrize("block", [2, 64])
def test_together_against_brute_force(spark, block):
    rng = random.Random(4)
    rows = [("m", f"b{rng.randrange(25)}", f"i{int(rng.random() ** 2 * 15)}") for _ in range(400)]
    rows += [("a", "big", f"i{k}") for k in range(12)] * 2 + [("a", f"b{k}", f"i{k % 3}") for k in range(30)]
    rows += [(None, "b", "i"), ("m", None, "i"), ("m", "b0", None)]
    sets = defaultdict(set)
    for kind, basket, item in rows:
        if None not in (kind, basket, item):
            sets[kind, basket].add(item)
    want = {}
    for kind in ("m", "a"):
        mine = [v for (k, _), v in sets.items() if k == kind]
        single = Counter(i for v in mine for i in v)
        both = Counter(p for v in mine for p in itertools.combinations(sorted(v), 2))
        for (i, j), n_ab in both.items():
            if n_ab >= 2 and n_ab * len(mine) >= 1.0 * single[i] * single[j]:
                want[kind, i, j] = (n_ab, single[i], single[j], len(mine))
    df = spark.createDataFrame(rows, "kind string, basket string, item string")
    found = together.items_together(df, "kind", "basket", "item", 2, 1.0, block)
    got = {(r["kind"], r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in found.collect()}
    assert got == want
    assert together.items_together(df.where("1 = 0"), "kind", "basket", "item").count() == 0


# --- tokens ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    lines = map(bytes.split, Path(P.path("byte_bpe_50k.tiktoken")).read_bytes().splitlines())
    ranks = {base64.b64decode(a): int(b) for a, b in lines}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "Hello  world, it's 1,234.5!\n\n  end", "a" * 3000, "אבג דהו בע\"מ", "界" * 500 + "，你好。", "", None, " ", "\n\t ", "<|endoftext|>",
    "👩‍⚖️ é é ﻿x  y", "baaaaaaaab aba aabaa", "ราย งาน", "x" * 5 + " " * 50 + "y", "हिन्दी है।",
]


def test_ids_are_those_of_the_public_tokenizer(spark, reference):
    rows = [(k, t, "extra") for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame([*rows, (0, TEXTS[0], "again")], "doc_id long, text string, ids string")
    found = tokens.token_ids(df, "doc_id", "text").collect()
    assert len(found) == len(TEXTS) + 1
    for r in found:
        assert r["ids"] == reference.encode_ordinary(TEXTS[r["doc_id"]] or "")
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df, "doc_id", "text").collect()}
    assert counts == {k: len(reference.encode_ordinary(t or "")) for k, t in enumerate(TEXTS)}
    assert tokens.token_ids(df.where("1 = 0"), "doc_id", "text").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab th e1א界", min_size=1, max_size=40), min_size=1, max_size=6))
def test_merges(reference, pieces):
    import pyarrow as pa

    tool = tokens.encoder(tokens.vocabulary_path())
    values, counts = tool.encode(pa.array([[p] for p in pieces]))
    assert values.tolist() == [i for p in pieces for i in reference._encode_single_piece(p.encode())]
    assert counts.sum() == len(values)


def test_bitmap():
    bitmap = tokens.RankBitmap(60_000)
    wanted = random.Random(1).sample(range(60_000), 500)
    for rank in wanted + wanted[:50]:
        bitmap.add(rank)
    assert [bitmap.take_first() for _ in range(500)] == sorted(wanted)
    assert bitmap.take_first() == -1


# --- packing -----------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(5)
    sizes = [rng.choice([5, 20, 60, 130, 200, 250]) + rng.randrange(9) for _ in range(900)] + [256] * 7 + [1000, 700, 0, None]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "id long, n_tokens long")
    found = packing.packed(df, "id", "n_tokens", 256).collect()
    pieces, load = defaultdict(list), Counter()
    for r in found:
        pieces[r["id"]].append((r["start"], r["n"]))
        if r["container"] is not None:
            load[r["container"]] += r["n"]
        assert (r["container"] is None) == (r["n"] == 0)
    assert set(pieces) == set(range(len(sizes)))
    for k, n in enumerate(sizes):
        at = 0
        for start, length in sorted(pieces[k]):
            assert start == at
            at += length
        assert at == (n or 0) and (len(pieces[k]) == 1 or n > 256)
    assert max(load.values()) <= 256
    import numpy as np

    cut = np.array([m for n in sizes if n for m in [256] * (n // 256) + [n % 256] * (n % 256 > 0)])
    assert len(load) <= 1.02 * (packing.best_fit(cut, 256).max() + 1)
    assert packing.packed(df.where("1 = 0"), "id", "n_tokens", 256).count() == 0


@pytest.mark.parametrize("capacity", [1, 7, 100, 129, 300])
def test_no_capacity_overflows(spark, capacity):
    df = spark.createDataFrame([(k, k % 37) for k in range(120)], "id long, n long")
    load = Counter()
    for r in packing.packed(df, "id", "n", capacity).collect():
        if r["container"]:
            load[r["container"]] += r["n"]
    assert max(load.values()) <= capacity and sum(load.values()) == sum(k % 37 for k in range(120))


def test_least_squares():
    import numpy as np

    a = np.array([[1.0, 2, 0], [0, 1, 3], [1, 0, 1]])
    x = packing.non_negative_least_squares(a, a @ np.array([2.0, 0, 1]))
    assert np.allclose(x, [2, 0, 1])


# --- sentences ---------------------------------------------------------------------------------

UNITS = [
    ["Version 2.14.1 went online.", "See www.docs.example.invalid/no.22 or write to a.b@c.example.invalid for it."],
    ["Mrs. X and J. R. Smith of Y Bros. & Co. Metals came at 6 p.m. on Monday.", "No. 19 was Z Inc.", "Who knew?!"],
    ["It closed at 6 p.m.", "Then all left."],
    ["eKarta paid Z Ltd. in 1991.", "eKarta, a unit of Z, said no."],
    ['He wrote: "It is late. It is wrong." and left.', "Nobody came... not even a clerk."],
    ["Am 21. Mai kam Dr. Y, z. B. um 9.30 Uhr.", "Das gilt u. a. für 657 Mio. Euro."],
    ["Офис на ул. Корому, д. 22, рядом.", "Решение принято в 2017 г.", "Муро сказал «Да. Нет.» и ушел."],
    ['עו"ד ד. שלהכתדת הזכיר את חברת אבג בע"מ.', "התקציב (כ-18.63 מ' ש\"ח) אושר.", "למה?!"],
    ["بدأت الجلسة الساعة 9.30 ص. وكان أول المتحدثين د. نامو.", "هل سأل أحد؟", "لا."],
    ["书记员写道：“太晚了。也不对。”然后离开了。", "为什么？！", "费用从1,671%升至44%。"],
    ["書記は「遅い。しかも間違いだ。」と書いて出て行った。", "なぜ？！"],
    ['सचिव ने लिखा: "देर हो गई। गलत भी है।" और चला गया।', "डॉ. बुगि ने 9.30 बजे कहा।"],
    ["กรรมการสนับสนุนร่าง (ดูรูปที่ 21)", "การประชุมเริ่มเวลา 9.30 น. โดยมีนิโซเป็นผู้พูด", "เหรัญญิกขอเลื่อนไป 9 สัปดาห์"],
]


def _found(spark, texts):
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, pos int")
    got = defaultdict(list)
    for r in sorted(sentences.sentence_units(df, "doc_id", "text").collect(), key=lambda r: (r["doc_id"], r["pos"])):
        text = texts[r["doc_id"]]
        assert text[r["start_char"] : r["end_char"]] == r["sentence"]
        got[r["doc_id"]].append(r["sentence"])
    return got


def test_sentences(spark):
    got = _found(spark, [" ".join(u) if not any("。" in x for x in u) else "".join(u) for u in UNITS])
    for k, want in enumerate(UNITS):
        assert got[k] == want


def test_lines_nulls_and_long_texts(spark):
    long = "One is here. " * 3000
    body = "The panel met for a long time and said very little about the matter that had brought it there, which nobody minded. It left"
    texts = [f"A title\n\nChair X Y:\n* first, one\n* second\n{body}\nNext one.", "wrapped text\ngoes on. And ends", None, "", " \n\t", long, "a\ue300b. \ue200 C"]
    got = _found(spark, texts)
    assert got[0] == ["A title", "Chair X Y:", "* first, one", "* second", body[: body.index(" It left")], "It left", "Next one."]
    assert got[1] == ["wrapped text\ngoes on.", "And ends"]
    assert not got[2] and not got[3] and not got[4]
    assert got[5] == ["One is here."] * 3000
    assert "".join(got[6]).replace(" ", "") == texts[6].replace(" ", "")


# --- names, linking, variants ------------------------------------------------------------------


LINES = [
    ('{h} מערכות בע"מ', "{l} Systems Ltd."), ('{h} מדיה בע"מ', "{l} Media Ltd."), ('{h} תרופות בע"מ', "{l} Pharmaceuticals Ltd."),
    ('{h} כימיקלים בע"מ', "{l} Chemicals Ltd."), ('{h} יעוץ וניהול בע"מ', "{l} Management Consulting Ltd."), ("עיריית {h}", "Municipality of {l}"),
    ("תאגיד המים {h}", "{l} Water Corporation"), ("עמותת {h} למען מים חופיים", "{l} Association for Coastal Waters"),
    ("עמותת {h} למען דיור ציבורי", "{l} Association for Public Housing"), ("עמותת {h} למען בריאות הציבור", "{l} Association for Public Health"),
]
BODIES = [
    ("משרד דיור ציבורי", "Ministry of Public Housing"), ("משרד בריאות הציבור", "Ministry of Public Health"), ("משרד מדיה", "Ministry of Media"), ("משרד מערכות", "Ministry of Systems"),
    ("משרד מים חופיים", None), ("רשות מים חופיים", "Coastal Waters Authority"), ("רשות דיור ציבורי", "Public Housing Authority"), ("רשות מדיה", "Media Authority"), ("רשות מערכות", "Systems Authority"),
]


def _cored(lines, n, seed):
    """n entries of each line with proper names of their own."""
    rng = random.Random(seed)
    hebrew = dict(zip("bgdzTlmnsprS", "בגדזטלמנספרש"))
    found = []
    for h, l in lines:
        for _ in range(n):
            core = [rng.choice("bgdzTlmnsprS") for _ in range(8)]
            latin = "".join(("tz" if c == "T" else "sh" if c == "S" else c) + "aeiou"[k % 5] for k, c in enumerate(core))
            found.append((h.format(h="".join(hebrew[c] for c in core)), l.format(l=latin.capitalize())))
    return found


REGISTER = _cored(LINES, 6, 8) + BODIES


def _listed(spark, rows, extra=()):
    whole = [(1000 + k, *r) for k, r in enumerate(rows)] + list(extra)
    return spark.createDataFrame(whole, "id long, name string, name_eng string")


@pytest.fixture(scope="module")
def learned(spark):
    return lexicon.learned(_listed(spark, REGISTER), ["name", "name_eng"])


def test_generic_words_are_learned(spark, learned):
    read = lambda n: names.organisation(n, learned)
    assert read("on behalf of X-Zokodofono Mgmt. Consulteng L.T.D.") == ("zokodofono", read("זקדפן יעוץ וניהול")[1])
    assert read("Munic. of Zokodofono") == read("Municpality of Zokodofono") == ("zokodofono", read("ערית אבג")[1])
    assert read("Min. of Public Health") == read("מ. בריאות הציבור") == read("משרד בריאות הציבור") != read("משרד דיור ציבורי")
    assert read("Zokodofono Football Club") == ("zokodofonofootballclub", [])
    assert learned.acronyms(read("משרד מים חופיים")[1]) >= {"mocw", "mcw"}
    empty = lexicon.learned(_listed(spark, REGISTER).where("1 = 0"), ["name", "name_eng"])
    assert names.organisation("Zokodofono Media Ltd.", empty) == ("zokodofonomedia", [])


def test_words_of_another_register(spark):
    """No word is known beforehand: libraries, bakeries and zoos are learned like the rest."""
    lines = [("ספריית {h}", "{l} Library"), ("מאפיית {h}", "{l} Bakery"), ("גן החיות {h}", "Zoological Gardens of {l}"), ("תיאטרון {h}", "{l} Theatre")]
    rows = _cored(lines, 12, 9)
    listed = _listed(spark, rows)
    typed, want = [], []
    for k, (h, l) in enumerate(rows):
        core = l.replace("Library", "").replace("Bakery", "").replace("Theatre", "").replace("Zoological Gardens of", "").strip()
        wrong = core[:4] + core[5:]  # a letter is missing
        typed += [(4 * k, h.upper()), (4 * k + 1, l.replace(core, wrong)), (4 * k + 2, l.replace("Library", "Libr.").replace("Zoological", "Zool.")), (4 * k + 3, f"{core} Sports Club")]
        want += [(4 * k, 1000 + k), (4 * k + 1, 1000 + k), (4 * k + 2, 1000 + k), (4 * k + 3, -1)]
    df = spark.createDataFrame(typed, "match_id long, org_name string")
    found = linking.linked(df, "match_id", "org_name", None, listed, "id", ["name", "name_eng"])
    assert sorted((r["match_id"], r["entity_id"]) for r in found.collect()) == want


def test_names():
    assert names.skeleton("חפצדמחש") == names.skeleton("chupitzdimuchesh")
    assert names.is_placeholder(" לא ידוע ") and names.is_placeholder("n/a") and not names.is_placeholder("Foo")
    assert names.distance("abcd", "abdc") == 1 and names.distance("abc", "xyz", 1) == 2


@settings(max_examples=30, deadline=None)
@given(st.data())
def test_distance_is_symmetric(data):
    a, b = data.draw(st.text("abc", max_size=6)), data.draw(st.text("abc", max_size=6))
    assert names.distance(a, b) == names.distance(b, a)


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.7, 0.8])
def test_similarity_join_is_exact(spark, threshold):
    rng = random.Random(6)
    draw = lambda n: [(f"{k}", sorted({f"t{int(rng.random() ** 3 * 30)}" for _ in range(rng.randrange(0, 9))})) for k in range(n)]
    wide = [f"u{k}" for k in range(200)]
    # of just the threshold, and of one token less
    sizes = [wide[:100], wide[:55], wide[:70], wide[:54], wide, wide[:140], wide[:110], wide[100:]]
    left, right = draw(60) + [(f"w{k}", w) for k, w in enumerate(sizes)], draw(60) + [(f"w{k}", w) for k, w in enumerate(sizes)]
    weight = {t: 1 + sum(map(ord, t)) % 3 if t[0] == "t" else 1 for _, x in left + right for t in x}
    of = lambda tokens: sum(weight[t] for t in tokens)
    want = {(a, b) for a, x in left for b, y in right if x and y and of({*x} & {*y}) / of({*x} | {*y}) >= threshold - 1e-12}
    schema = "id string, tokens array<struct<token: string, weight: int>>"
    made = lambda rows: spark.createDataFrame([(k, [(t, weight[t]) for t in x]) for k, x in rows], schema)
    found = linking.set_similarity_join(made(left), made(right), threshold)
    got = [(r["left_id"], r["right_id"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    if threshold == 0.55:
        assert ("w0", "w1") in want and ("w0", "w3") not in want


def test_linking(spark):
    own = [(1, 'רהגלכהז תרופות בע"מ', None), (2, "עיריית מבטזשקר", "Municipality of Mebitzashaqar"), (3, "תאגיד המים מבטזשקר", None), (4, "משרד מים חופיים", None), (5, None, None)]
    register = _listed(spark, [r for r in REGISTER if r[0] != "משרד מים חופיים"], own)
    rows = [
        (1, 'נציגי רהגלכהז תרופות בע"מ', None), (2, "Rehugolkohuz Pharma Ltd.", None), (3, "Munic. of Mebitzashaqar", None), (4, "מבטזשקר", "תאג' המים מבטזשקר"),
        (5, "MoCW", None), (6, "Mebitzashaqar Football Club", None), (7, "לא ידוע", None), (8, " ", "x"), (9, None, "x"), (10, 'רהגלכהז מדיה בע"מ', None),
        (10, 'רהגלכהז מדיה בע"מ', None), (11, "בע\"מ", None), (12, "x" * 5000, None),
    ]
    df = spark.createDataFrame(rows, "match_id long, org_name string, entity_name string")
    found = linking.linked(df, "match_id", "org_name", "entity_name", register, "id", ["name", "name_eng"])
    got = sorted((r["match_id"], r["entity_id"]) for r in found.collect())
    assert got == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, -1), (7, -1), (10, -1), (10, -1), (11, -1), (12, -1)]
    none = linking.linked(df, "match_id", "org_name", None, register.where("1 = 0"), "id", ["name", "name_eng"])
    assert {r["entity_id"] for r in none.collect()} == {-1}
    assert linking.linked(df.where("1 = 0"), "match_id", "org_name", "entity_name", register, "id", ["name", "name_eng"]).count() == 0


def test_radius_links_are_exact(spark):
    rng = random.Random(7)
    keys = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8))) for _ in range(120)} | {"dcba", "dbca", "cdba"}
    base = "abcdefghijklmnopqrstuvwxyz" * 2
    keys |= {base, base[1:], base[:30] + "#" + base[31:], base[:10] + base[11] + base[10] + base[12:], base[:22], base[:23], base[:24], base[:25], base[:26]}
    rows = [("s", k) for k in sorted(keys)] + [("t", "abab"), ("t", "")]
    got = {(r["space"], r["a"], r["b"]): r["d"] for r in variants.radius_links(spark.createDataFrame(rows, "space string, key string")).collect()}
    want = {("s", a, b): names.distance(a, b) for a, b in itertools.combinations(sorted(keys), 2) if names.distance(a, b) <= variants.RADIUS}
    assert got == want
    # a link depends on its two keys only
    some = [r for r in rows if hash(r[1]) % 3 or len(r[1]) > 20]
    part = {(r["space"], r["a"], r["b"]) for r in variants.radius_links(spark.createDataFrame(some, "space string, key string")).collect()}
    assert part == {x for x in want if ("s", x[1]) in some and ("s", x[2]) in some}


def _same(found):
    by = defaultdict(set)
    for r in found.collect():
        by[r["entity"]].add(r["name"])
    return sorted((sorted(v) for v in by.values()), key=repr)


def test_organisations(spark):
    spelled = [
        'ננהפכבך מערכות בע"מ', "ננהפבך מער' בעמ", "Nonhopkobuk Systems Ltd.", 'ננהפכבך מדיה בע"מ', "MoCW", "משרד מים חופיים", "אחר", "Zokodofono", "rep. of Zokodofno Media",
        "Zokodofono Media Ltd.", ".", "x" * 3000,
    ]
    df = spark.createDataFrame([(n, 5) for n in spelled], "name string, rows long")
    register = _listed(spark, REGISTER)
    got = _same(variants.organisations(df, register, ["name", "name_eng"]))
    assert ["MoCW", "משרד מים חופיים"] in got
    assert sorted(["Zokodofono", "rep. of Zokodofno Media", "Zokodofono Media Ltd."]) in got
    assert sorted(spelled[:3]) in got and ['ננהפכבך מדיה בע"מ'] in got
    assert not any("אחר" in v or "." in v for v in got)
    assert variants.organisations(df.where("1 = 0"), register, ["name", "name_eng"]).count() == 0


def test_persons(spark):
    spelled = ["Daniel Pashugefawe", "Danny Pashugefawe", "Pashugefawe, D.", "Dr. DANIEL PASHUGEFWE", "Clara Pashugefawe", "Helena Vunosujajo", "H Vunosujajo", "Hugo Vunosujajo", "..", "עו\"ד יוסי גסטשטמף", "גסטשטמף יוסף"]
    df = spark.createDataFrame([(n, 3) for n in spelled], "name string, rows long")
    nick = spark.createDataFrame([("Daniel", "Danny"), ("יוסף", "יוסי")], "formal string, short_form string")
    got = _same(variants.persons(df, nick))
    assert sorted(spelled[:4]) in got and ["Clara Pashugefawe"] in got
    assert ["H Vunosujajo"] in got and ["Helena Vunosujajo"] in got
    assert sorted(spelled[-2:]) in got
    assert variants.persons(df.where("1 = 0"), nick).count() == 0


def test_entities_dont_depend_on_row_counts(spark):
    """The same names among many others, and the query's tables with every row many times, give the same links."""
    cores = ["Zokodofono", "Zokodofno", "Zokodofo", "Zokadofo"]
    spelled = [f"{c} Media" for c in cores]
    register = _listed(spark, REGISTER)
    found = []
    for many in (1, 3, 100):
        df = spark.createDataFrame([(n,) for n in spelled for _ in range(many)], "name string").distinct()
        found.append(_same(variants.organisations(df, register, ["name", "name_eng"])))
    assert found[0] == found[1] == found[2]
    more = [f"{latin} Media" for _, latin in _cored([("{h}", "{l}")], 40, 11)]
    among = _same(variants.organisations(spark.createDataFrame([(n,) for n in spelled + more], "name string"), register, ["name", "name_eng"]))
    assert [v for v in among if v[0] in spelled] == found[0]
    people = ["Tomer Oz", "Oz Tomer", "Tomer Os"]
    given = [f"Tomer {latin}" for _, latin in _cored([("{h}", "{l}")], 45, 12)]
    nick = spark.createDataFrame([("Daniel", "Danny")], "formal string, short_form string")
    for size in (8, 45):
        df = spark.createDataFrame([(n,) for n in people + given[:size]], "name string")
        assert sorted(people) in _same(variants.persons(df, nick))
