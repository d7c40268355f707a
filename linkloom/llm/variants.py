"""Spellings of one person or organisation, linked.

Names are reduced to a key, the part that identifies: a surname, or the core of an organisation's
name. Keys are partitioned in the metric space of edits: each is assigned to a pivot within
COVER edits, and, by the triangle inequality, copied to every pivot within COVER + RADIUS, so that two keys
within RADIUS edits meet in a cell, where an exact radius join with a true edit metric finds them.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm import lexicon as lexicons
from linkloom.llm import metric, names
from linkloom.llm.components import components
from linkloom.runtime import written

#: Edits between a key and its pivot, and between linked keys; a swap of neighbouring letters is one edit.
COVER = 1
RADIUS = 1
#: One key in so many, by a hash, is a pivot from the start; keys far from all of these become pivots as well.
PIVOTS_OF = 4


def radius_links(keys: DataFrame) -> DataFrame:
    """(space, a, b, d): pairs a < b of keys of one space within RADIUS edits.

    keys: space and key, distinct. A link depends on its two keys only, whatever other keys or how many rows there are.
    Exact: no pair within RADIUS edits is lost. Keys of any length are linked, empty ones to none.
    """
    usable = written(keys.where(F.length("key") > 0).select("space", "key"))
    reach = COVER + RADIUS
    probes = written(metric.signed(usable, True, reach))
    chosen = usable.where(F.pmod(F.xxhash64("key"), F.lit(PIVOTS_OF)) == 0)
    to_pivots = lambda pivots: metric.within(probes, metric.signed(pivots, False, reach), reach).withColumnRenamed("other", "pivot")
    routed = written(to_pivots(chosen))
    covered = routed.where(F.col("d") <= COVER).select("space", "key").distinct()
    own = usable.join(covered, ["space", "key"], "left_anti")
    members = written(routed.unionByName(to_pivots(own)))
    nearest = Window.partitionBy("space", "key").orderBy("d", "pivot")
    home = members.where(F.col("d") <= COVER).withColumn("k", F.row_number().over(nearest)).where("k = 1")
    inside = home.select("space", "pivot", F.col("key").alias("x")).join(
        members.select("space", "pivot", F.col("key").alias("y")), ["space", "pivot"]
    )
    near = inside.where((F.col("x") != F.col("y")) & (F.abs(F.length("x") - F.length("y")) <= RADIUS))
    near = near.withColumn("d", metric.edits("x", "y")).where(F.col("d") <= RADIUS)
    return near.select("space", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "d").distinct()


def _tagged(*columns: str) -> Column:
    return F.concat_ws("\u0001", *columns)


#: Gives keys, is sent their links, gives edges, is sent their groups, gives (name, entity).
Steps = Generator[DataFrame, DataFrame, None]


def resolved(*kinds: Steps) -> list[DataFrame]:
    """The results of several kinds of names, whose keys and whose edges go through one radius join and one grouping.

    The spaces of the kinds differ.
    """
    union = lambda tables: tables[0] if len(tables) == 1 else tables[0].unionByName(union(tables[1:]))
    links = written(radius_links(union([next(k) for k in kinds]).distinct()))
    edges = written(union([k.send(links) for k in kinds]))
    groups = written(components(edges, "a", "b"))
    return [written(k.send(groups)) for k in kinds]


def organisations(spelled: DataFrame, register: DataFrame, name_columns: list[str]) -> DataFrame:
    """(name, entity) of names of organisations, see organisation_steps."""
    return resolved(organisation_steps(spelled, register, name_columns))[0]


def persons(spelled: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(name, entity) of names of persons, see person_steps."""
    return resolved(person_steps(spelled, nicknames))[0]


def organisation_steps(spelled: DataFrame, register: DataFrame, name_columns: list[str]) -> Steps:
    """(name, entity): names of organisations and the entity each denotes.

    spelled: name, distinct names; register: entries of organisations, from whose name columns the generic words, their
    translations and acronyms are learned (the organisations themselves need not be in it). The core groups names; within a
    group the concepts (line of business, kind of body, field) tell entities apart. Cores within RADIUS edits are linked where
    their names share a concept or one has none: Latin ones as letters, and as consonants with Hebrew ones.
    A name whose concepts are part of those of just one entity of the group denotes that entity; one that
    fits several is an entity of its own. Names without a core go by their concepts. Placeholders and
    names without either don't come out. Equal names come out once.
    """
    learned = lexicons.learned(register, name_columns)
    listed = register.select(F.explode(F.array(*name_columns)).alias("name")).where(F.length(F.trim("name")) > 0)
    own = written(lexicons.read_names(spelled, learned).where("not void"))
    acronyms = lexicons.acronym_table(lexicons.read_names(listed.distinct(), learned).unionByName(own).dropDuplicates(["name"]), learned)
    read = written(lexicons.with_acronyms(own, acronyms))
    # a Latin core has two keys, its letters and its consonants
    cored = read.where("core <> ''").select("core", "hebrew", "skeleton", F.array_sort("concepts").alias("concepts")).distinct()
    both = F.when(F.col("hebrew"), F.array(F.struct(F.lit("s").alias("space"), F.col("skeleton").alias("key")))).otherwise(
        F.array(F.struct(F.lit("r").alias("space"), F.col("core").alias("key")), F.struct(F.lit("s").alias("space"), F.col("skeleton").alias("key")))
    )
    keyed = written(cored.select("core", "hebrew", "concepts", F.explode(both).alias("k")).select("core", "hebrew", "concepts", "k.space", "k.key").where("key <> ''"))
    nodes = keyed.select("space", "key", "hebrew", "concepts").distinct()
    links = yield keyed.select("space", "key").distinct()
    near = links.where(F.least(F.length("a"), F.length("b")) > 3)
    same = keyed.select("space", F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0).alias("d")).distinct()
    one = nodes.toDF("space", "a", "a_hebrew", "a_concepts")
    other = nodes.toDF("space", "b", "b_hebrew", "b_concepts")
    bare = (F.size("a_concepts") == 0) | (F.size("b_concepts") == 0)
    agreed = F.arrays_overlap("a_concepts", "b_concepts") | bare
    met = near.unionByName(same).join(one, ["space", "a"]).join(other, ["space", "b"]).where(agreed)
    letters = met.where("space = 'r' and a <> b").select(_tagged("space", "a").alias("a"), _tagged("space", "b").alias("b"))
    # consonants count where a Hebrew core has them
    sounded = met.where("space = 's' and (a_hebrew or b_hebrew)")
    sound = sounded.select(_tagged("space", "a").alias("a"), _tagged("space", "b").alias("b")).distinct()
    ends = lambda a, h, c: sounded.where(f"not {h}").select(F.col(a).alias("skeleton"), F.col(c).alias("concepts"))
    heard = ends("a", "a_hebrew", "a_concepts").unionByName(ends("b", "b_hebrew", "b_concepts")).distinct()
    bridges = cored.where("not hebrew").join(heard, ["skeleton", "concepts"], "left_semi").select(
        F.concat_ws("\u0001", F.lit("r"), "core").alias("a"), F.concat_ws("\u0001", F.lit("s"), "skeleton").alias("b")
    )
    own_key = F.when(F.col("hebrew"), F.concat_ws("\u0001", F.lit("s"), "skeleton")).otherwise(F.concat_ws("\u0001", F.lit("r"), "core"))
    alone = cored.select(own_key.alias("a"), own_key.alias("b"))
    groups = yield letters.unionByName(sound).unionByName(bridges).unionByName(alone).distinct()
    placed = read.withColumn("term", F.when(F.col("core") != "", own_key)).join(groups, "term", "left")
    placed = written(placed.select("name", F.coalesce("group_term", F.lit("")).alias("comp"), "concepts", "tokens"))
    yield _told_apart(placed)


def _told_apart(placed: DataFrame) -> DataFrame:
    """(name, entity) of names placed in groups (comp), told apart by their concepts; the widest sets of a group are its entities."""
    rarest = F.array_max(F.transform("tokens", lambda t: F.struct(t["weight"].alias("weight"), t["token"].alias("token"))))["token"]
    kinds = written(placed.select("comp", "concepts", F.coalesce(rarest, F.lit("")).alias("rarest")).distinct())
    # a set meets those that hold its rarest concept, so that no group is joined with itself as a whole
    holding = kinds.select("comp", F.col("concepts").alias("wide"), F.explode("concepts").alias("rarest"))
    wider = kinds.where("rarest <> ''").join(holding, ["comp", "rarest"]).where(F.size(F.array_except("concepts", "wide")) == 0)
    wider = written(wider.select("comp", "concepts", "wide"))
    inner = wider.where(F.size("wide") > F.size("concepts")).select("comp", "concepts").distinct()
    widest = kinds.where("rarest <> ''").select("comp", "concepts").join(inner, ["comp", "concepts"], "left_anti")
    joined = lambda c: F.array_join(c, "|")
    fits = wider.join(widest.withColumnRenamed("concepts", "wide"), ["comp", "wide"], "left_semi").groupBy("comp", "concepts").agg(
        F.min(joined("wide")).alias("only"), F.count(F.lit(1)).alias("n")
    )
    # names of a core alone fit every entity of their group
    of_bare = widest.groupBy("comp").agg(F.min(joined("concepts")).alias("only"), F.count(F.lit(1)).alias("n"))
    bare = kinds.where("rarest = ''").join(of_bare, "comp", "left").select("comp", "concepts", F.coalesce("only", F.lit("")).alias("only"), F.coalesce("n", F.lit(1)).alias("n"))
    which = F.when(F.col("n") == 1, F.col("only")).otherwise(F.concat(F.lit("?"), joined("concepts")))
    entities = fits.unionByName(bare).select("comp", "concepts", F.concat_ws("\u0001", "comp", which).alias("entity"))
    return placed.join(entities, ["comp", "concepts"]).select("name", "entity")


def person_steps(spelled: DataFrame, nicknames: DataFrame) -> Steps:
    """(name, entity): names of persons and the person each denotes.

    spelled: name, distinct names; nicknames: formal and short_form. A name is a surname, a given name and initials in any
    order, with titles. Of two words the given name is the one that stands in nicknames or else in more names,
    spellings within one edit counted together; if that is equal, the shorter. Names are linked if their surnames
    are within RADIUS edits and their given names agree: equal, short forms of one, or within one edit, two from six
    letters on. An initial, or no given name, denotes the person of a surname within RADIUS edits whom
    it fits, if it fits just one. Names without letters don't come out.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "words": [names.person(n) for n in batch["name"]]})

    read = written(spelled.select("name").mapInPandas(split, "name string, words array<string>"))
    plain = lambda c: F.translate(F.lower(c), "ךםןףץ", "כמנפצ")
    short = nicknames.select(plain("short_form").alias("word"), plain("formal").alias("formal")).where("word is not null and formal is not null")
    formal = short.groupBy("word").agg(F.min("formal").alias("formal"))
    word = read.select("name", F.explode(F.array_distinct("words")).alias("word"))
    often = written(word.groupBy("word").agg(F.count(F.lit(1)).alias("often")))
    known = often.select("word").intersect(short.select(F.explode(F.array("word", "formal")).alias("word"))).withColumn("nick", F.lit(True))
    # a misspelt word is as common as the word meant; initials have no spellings
    script = F.when(F.col("word").rlike("[א-ת]"), "h").otherwise("l")
    spelt = often.where(F.length("word") > 1).select(script.alias("space"), F.col("word").alias("key"))
    near_words = yield spelt
    near_words = near_words.where("space in ('h', 'l')")
    ways = near_words.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(near_words.select(F.col("b").alias("word"), F.col("a").alias("other")))
    others = ways.join(often.withColumnRenamed("word", "other"), "other")
    common = often.join(others.groupBy("word").agg(F.max("often").alias("of_other")), "word", "left").join(known, "word", "left").join(formal, "word", "left")
    common = written(common.select("word", F.coalesce("nick", F.lit(False)).alias("nick"), F.greatest("often", F.coalesce("of_other", F.lit(0))).alias("often"), F.coalesce("formal", "word").alias("given")))
    described = F.struct("nick", "often", (-F.length("word")).alias("less"), "word", "given", F.length("word").alias("n"))
    parts = word.join(common, "word").groupBy("name").agg(F.array_sort(F.collect_list(described)).alias("w"))  # of one name, which is short
    full = F.filter("w", lambda x: x["n"] > 1)
    letters = F.transform(F.filter("w", lambda x: x["n"] == 1), lambda x: x["word"])
    parts = parts.select("name", full.alias("full"), letters.alias("letters")).where(F.size("full") > 0)
    several = F.size("full") > 1
    best = F.element_at("full", -1)
    rest = F.array_max(F.transform(F.slice("full", F.lit(1), F.size("full") - 1), lambda x: F.struct(x["n"].alias("n"), x["word"].alias("word"))))
    given = F.when(several, best["given"])
    surname = F.when(several, rest["word"]).otherwise(best["word"])
    initial = F.coalesce(F.substring(given, 1, 1), F.get("letters", F.lit(0)))
    profiles = written(
        parts.select("name", F.when(surname.rlike("[א-ת]"), "h").otherwise("l").alias("space"), surname.alias("surname"), given.alias("given"), initial.alias("initial"))
    )
    surnames = near_words  # surnames are words
    nodes = profiles.where("given is not null").select("space", "surname", "given").distinct()
    node = lambda s, g: F.concat_ws("\u0001", "space", s, g)
    same_given = nodes.join(surnames, (nodes["space"] == surnames["space"]) & (nodes["surname"] == surnames["a"])).select(nodes["space"], "surname", "given", "b")
    to = nodes.select("space", F.col("surname").alias("b"), "given")
    by_surname = same_given.join(to, ["space", "b", "given"]).select(node("surname", "given").alias("a"), node("b", "given").alias("b"))
    # given names of one surname within an edit or two
    one = nodes.toDF("space", "surname", "g")
    two = nodes.toDF("space", "surname", "h")
    least = F.least(F.length("g"), F.length("h"))
    limit = F.when(least >= 6, 2).when(least >= 3, 1).otherwise(0)
    by_given = one.join(two, ["space", "surname"]).where("g < h").where(metric.edits("g", "h") <= limit).select(node("surname", "g").alias("a"), node("surname", "h").alias("b"))
    alone = nodes.select(node("surname", "given").alias("a"), node("surname", "given").alias("b"))
    groups = yield by_surname.unionByName(by_given).unionByName(alone)
    placed = profiles.where("given is not null").join(groups, node("surname", "given") == F.col("term")).select("name", "space", "surname", "initial", F.col("group_term").alias("comp"))
    placed = written(placed)
    # names without a given name go to the one person of their surname, or of one near it, whom they fit
    people = placed.select("space", "surname", F.substring(F.substring_index("comp", "\u0001", -1), 1, 1).alias("of"), "initial", "comp").distinct()
    lone = profiles.where("given is null").select("name", "space", F.col("surname").alias("own"), "initial")
    either = surnames.select("space", F.col("a").alias("own"), F.col("b").alias("surname")).unionByName(surnames.select("space", F.col("b").alias("own"), F.col("a").alias("surname")))
    asked = lone.select("space", "own", F.coalesce("initial", F.lit("")).alias("asked")).distinct()
    reach = asked.select("space", "own", "asked", F.col("own").alias("surname")).unionByName(asked.join(either, ["space", "own"]).select("space", "own", "asked", "surname"))
    met = reach.join(people, ["space", "surname"]).where((F.col("asked") == "") | (F.col("asked") == F.col("initial")))
    fitting = met.groupBy("space", "own", "asked").agg(F.min("comp").alias("comp"), F.count_distinct("comp").alias("n"))
    found = lone.withColumn("asked", F.coalesce("initial", F.lit(""))).join(fitting, ["space", "own", "asked"], "left")
    itself = F.concat_ws("\u0001", "space", "own", F.concat(F.lit("?"), "asked"))
    of_lone = found.select("name", F.when(F.col("n") == 1, F.col("comp")).otherwise(itself).alias("entity"))
    yield placed.select("name", F.col("comp").alias("entity")).unionByName(of_lone)


def spelling_pairs(named: DataFrame) -> DataFrame:
    """(name_a, name_b) of all pairs of different names of one entity, name_a < name_b."""
    a = named.select("entity", F.col("name").alias("name_a"))
    b = named.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
