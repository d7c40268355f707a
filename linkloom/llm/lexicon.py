"""The generic words of a register of organisations, and which words of two languages mean the same.

A word that more than one in a thousand entries has is generic. Words of two languages stand for one
concept if nearly all bilingual entries that have the one have the other; so do words of one language
that only occur together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import names
from linkloom.runtime import forget, written

#: A word is generic from this share of the entries on, and in no fewer entries than LEAST.
SHARE = 0.001
LEAST = 4
#: Words whose entries agree to this share (Dice) are one concept.
AGREEMENT = 0.8


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, a, b, n): entries, words, leading words, words of bilingual entries, pairs of words across scripts and within a name."""
    void = {w.translate(names.FINALS) for w in f"{names.FILLERS} {names.LEGAL_FORMS}".split()}
    for batch in batches:
        n: Counter = Counter()
        for entry in zip(*(batch[c] for c in batch.columns)):
            read = [[w for w in names.words(x) if w not in void] for x in {x for x in entry if x}]
            all_words = {w for r in read for w in r}
            hebrew = {w for w in all_words if names.is_hebrew(w)}
            latin = all_words - hebrew
            n["n", "", ""] += 1
            for w in all_words:
                n["w", w, ""] += 1
            for w in {r[0] for r in read if r}:
                n["l", w, ""] += 1
            if hebrew and latin:
                for w in all_words:
                    n["b", w, ""] += 1
            for a in all_words:
                for b in all_words:
                    if a < b:
                        n["t" if hebrew and latin else "c", a, b] += 1
        yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["kind", "a", "b", "n"])


def learned(register: DataFrame, name_columns: list[str]) -> names.Lexicon:
    """The lexicon of all entries of a register, whose name columns may be of different languages; null names count for nothing.

    What reaches the driver is bounded: at most m / SHARE generic words, m the mean number of words of an
    entry, and the pairs of these that occur. An empty register gives an empty lexicon.
    """
    counted = register.select(*name_columns).mapInPandas(_counted, "kind string, a string, b string, n long")
    counts = written(counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))
    entries = sum(r["n"] for r in counts.where("kind = 'n'").collect())
    least = max(LEAST, math.ceil(entries * SHARE))
    generic = counts.where((F.col("kind") == "w") & (F.col("n") >= least)).select("a", "n")
    often = {r["a"]: r["n"] for r in generic.collect()}
    of_words = counts.where("kind in ('l', 'b')").join(generic.select("a"), "a", "left_semi")
    both = counts.where("kind in ('t', 'c')").join(generic.select("a"), "a", "left_semi").join(generic.select(F.col("a").alias("b")), "b", "left_semi")
    single: dict[tuple[str, str], int] = {}
    pairs: Counter = Counter()
    across: dict[tuple[str, str], int] = {}
    for r in of_words.unionByName(both).collect():
        if r["kind"] in "lb":
            single[r["kind"], r["a"]] = r["n"]
            continue
        pairs[r["a"], r["b"]] += r["n"]
        if r["kind"] == "t":
            across[r["a"], r["b"]] = r["n"]
    forget(counts)
    root = {w: w for w in often}

    def find(w: str) -> str:
        while root[w] != w:
            w = root[w]
        return w

    for (a, b), n in sorted(pairs.items()):
        two_scripts = names.is_hebrew(a) != names.is_hebrew(b)
        met = across.get((a, b), 0) if two_scripts else n
        size = single.get(("b", a), 0) + single.get(("b", b), 0) if two_scripts else often[a] + often[b]
        if size and 2 * met >= AGREEMENT * size:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    concept_often: Counter = Counter()
    for w, n in often.items():
        concept_often[find(w)] = max(concept_often[find(w)], n)
    words = {w: (find(w), n, single.get(("l", w), 0)) for w, n in often.items()}
    together: Counter = Counter()
    for (a, b), n in pairs.items():
        x, y = find(a), find(b)
        if x != y:
            together[min(x, y), max(x, y)] += n
    weight = lambda n: max(1, round(math.log(max(entries, 2) / n) ** 2 / 5))
    # a concept of one language that always goes with others, each of which always goes with it, is held in them
    scripts: dict[str, set[bool]] = {}
    for w in often:
        scripts.setdefault(find(w), set()).add(names.is_hebrew(w))
    lexicon = names.Lexicon(words, dict(together))
    lexicon.weights = {c: weight(n) for c, n in concept_often.items()}
    lexicon.core_weight = weight(1)
    for c, s in scripts.items():
        holders = {o: n for (x, y), n in together.items() if c in (x, y) for o in [y if x == c else x] if n >= AGREEMENT * concept_often[o]}
        if len(s) == 1 and sum(holders.values()) >= AGREEMENT * concept_often[c]:
            lexicon.held[c] = frozenset(holders)
    _learn_initials(register, name_columns, lexicon)
    return lexicon


def _learn_initials(register: DataFrame, name_columns: list[str], lexicon: names.Lexicon) -> None:
    """Sets the initials of each concept in Latin letters, and how names without a core put the kind of body: first, with which word after it, or last."""

    def phrased(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: Counter = Counter()
            for name in {x for c in batch.columns for x in batch[c] if x and not names.is_hebrew(x)}:
                phrases, places = lexicon.phrases(names.words(name))
                for concept, initials in phrases:
                    n["i", concept, initials] += 1
                for kind, pattern in places:
                    n["k", kind, pattern] += 1
            yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["kind", "a", "b", "n"])

    counted = register.select(*name_columns).mapInPandas(phrased, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    # a row per concept and pattern, and of the initials of a concept the commonest
    best = counted.groupBy("kind", "a", F.when(F.col("kind") == "k", F.col("b")).alias("of")).agg(F.max(F.struct("n", "b"))["b"].alias("b"))
    for r in best.collect():
        if r["kind"] == "i":
            lexicon.initials[r["a"]] = r["b"]
        else:
            lexicon.places.setdefault(r["a"], set()).add(r["b"])


SCHEMA = "name string, core string, concepts array<string>, tokens array<struct<token: string, weight: int>>, hebrew boolean, skeleton string, void boolean"


def read_names(rows: DataFrame, lexicon: names.Lexicon) -> DataFrame:
    """rows of distinct names (column name), read: core, concepts, hebrew (the core), skeleton (its consonants), void.

    tokens are the concepts with their weights, the square of ln(entries / entries with it); void names are
    placeholders or have neither core nor concepts.
    """

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name in batch["name"]:
                core, concepts = names.organisation(name, lexicon)
                tokens = [{"token": c, "weight": lexicon.weights[c]} for c in concepts]
                void = names.is_placeholder(name) or not (core or concepts)
                out.append((name, core, concepts, tokens, names.is_hebrew(core), names.skeleton(core), void))
            yield pd.DataFrame(out, columns=["name", "core", "concepts", "tokens", "hebrew", "skeleton", "void"])

    return rows.select("name").mapInPandas(parsed, SCHEMA)


def acronym_table(read: DataFrame, lexicon: names.Lexicon) -> DataFrame:
    """(acronym, concepts, tokens) of read names without a core, those not in Latin letters by the initials of their concepts.

    Acronyms of several sets of concepts are left out.
    """

    def initials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted(names.acronyms(n) | lexicon.acronyms(list(c))) for n, c in zip(batch["name"], batch["concepts"])]
            made = batch.assign(acronym=found).explode("acronym")
            yield made[["acronym", "concepts", "tokens"]].dropna(subset=["acronym"])

    schema = "acronym string, concepts array<string>, tokens array<struct<token: string, weight: int>>"
    made = read.where("core = '' and not void").select("name", "concepts", "tokens").mapInPandas(initials, schema)
    sets = made.distinct().groupBy("acronym").agg(F.count(F.lit(1)).alias("n"), F.min("concepts").alias("concepts"), F.min("tokens").alias("tokens"))
    return sets.where("n = 1").drop("n")


def with_acronyms(read: DataFrame, table: DataFrame) -> DataFrame:
    """read names, those that are an acronym of the table by the concepts that it stands for."""
    known = table.select(F.col("acronym").alias("core"), F.col("concepts").alias("_c"), F.col("tokens").alias("_t"))
    joined = read.join(known, "core", "left")
    short = F.col("_c").isNotNull() & (F.size("concepts") == 0)
    return joined.select(
        "name",
        F.when(short, "").otherwise(F.col("core")).alias("core"),
        F.when(short, F.col("_c")).otherwise(F.col("concepts")).alias("concepts"),
        F.when(short, F.col("_t")).otherwise(F.col("tokens")).alias("tokens"),
        "hebrew",
        F.when(short, "").otherwise(F.col("skeleton")).alias("skeleton"),
        "void",
    )
