"""Mapping freely typed values to the entries of a reference list.

Typing errors in the proper names are mended first: each typed core goes to the cores of the list within a
few edits. A prefix-filter set-similarity join then maps the sets of core and concepts: tokens are ordered by
global rarity, only rare prefixes are joined, length and positional filters drop most pairs, the weighted Jaccard
similarity of the rest is computed exactly, and the best is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.columns import computed_once
from linkloom.llm import lexicon, metric
from linkloom.runtime import written

#: Weighted Jaccard similarity of the sets of a typed name and an entity from which they may be one.
THRESHOLD = 0.5
#: Edits between a typed core and one of the list.
REACH = 2
_ROUNDING = 1e-9


def set_similarity_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, jaccard) of all pairs of token sets of at least this weighted Jaccard similarity.

    Both sides have the columns id and tokens, a list of distinct (token, weight), where a token has one positive weight
    everywhere. Empty and null lists match nothing. Exact: two sets of that similarity share a token of their
    prefixes in any common order; the order is by rarity over both sides, then by the token. Only ids
    travel through the join; a hot token is split by the skew join of the adaptive execution.
    """
    sides = left.select(F.lit("l").alias("side"), "id", "tokens").unionByName(
        right.select(F.lit("r").alias("side"), "id", "tokens")
    )
    sides = written(sides.where(F.size("tokens") > 0))
    tokens = sides.select("side", "id", F.explode("tokens").alias("t")).select("side", "id", "t.token", F.col("t.weight").cast("double").alias("w"))
    rarity = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    ranked = tokens.join(rarity, "token").groupBy("side", "id")  # of one set, which is small
    ordered = ranked.agg(F.array_sort(F.collect_list(F.struct("often", "token", "w"))).alias("set"), F.sum("w").alias("n"))
    weight = lambda list_: F.aggregate(list_, F.lit(0.0), lambda a, t: a + t["w"])
    # rest: the weight from a token on
    rests = F.transform("set", lambda t, k: F.struct(t["token"].alias("token"), t["w"].alias("w"), weight(F.slice("set", k + 1, F.size("set"))).alias("rest")))
    ordered = written(computed_once(ordered.select("side", "id", "n", "set"), "_r", rests).select("side", "id", "n", F.col("_r").alias("set")))
    prefix = F.filter("set", lambda t: t["rest"] >= F.col("n") * threshold - _ROUNDING)
    prefixes = ordered.select("side", "id", "n", F.explode(prefix).alias("t")).select("side", "id", "n", "t.token", "t.rest")
    l_side = prefixes.where("side = 'l'").select("token", F.col("id").alias("left_id"), "n", "rest")
    r_side = prefixes.where("side = 'r'").select("token", F.col("id").alias("right_id"), F.col("n").alias("m"), F.col("rest").alias("r_rest"))
    n, m = F.col("n"), F.col("m")
    needed = (n + m) * (threshold / (1 + threshold)) - _ROUNDING
    # the first token that both prefixes share passes the positional filter if the pair is similar
    met = (
        l_side.join(r_side, "token")
        .where((m >= n * threshold - _ROUNDING) & (n >= m * threshold - _ROUNDING))
        .where(F.least("rest", "r_rest") >= needed)
        .select("left_id", "right_id", "n", "m")
        .distinct()
    )
    bare = F.transform("set", lambda t: F.struct(t["token"].alias("token"), t["w"].alias("w")))
    l_sets = ordered.where("side = 'l'").select(F.col("id").alias("left_id"), bare.alias("a"))
    r_sets = ordered.where("side = 'r'").select(F.col("id").alias("right_id"), bare.alias("b"))
    both = weight(F.array_intersect("a", "b"))
    verified = met.join(l_sets, "left_id").join(r_sets, "right_id")
    similar = verified.select("left_id", "right_id", (both / (n + m - both)).alias("jaccard"))
    return similar.where(F.col("jaccard") >= threshold - _ROUNDING)


def near_cores(typed: DataFrame, listed: DataFrame) -> DataFrame:
    """(core, e_core, far): typed cores and those of the list within REACH edits, fewer for short ones.

    typed and listed: core, hebrew and skeleton. Latin cores are compared as letters, others as consonants.
    """

    def keyed(rows: DataFrame) -> DataFrame:
        cores = rows.where("core <> ''").select("core", "hebrew", "skeleton").distinct()
        letters = cores.where("not hebrew").select(F.lit("r").alias("space"), F.col("core").alias("key"), "core", "hebrew")
        return letters.unionByName(cores.where("skeleton <> ''").select(F.lit("s").alias("space"), F.col("skeleton").alias("key"), "core", "hebrew"))

    one, other = written(keyed(typed)), written(keyed(listed))
    sign = lambda keys, probing: metric.signed(keys.select("space", "key").distinct(), probing, REACH)
    near = metric.within(sign(one, True), sign(other, False), REACH)
    least = F.least(F.length("key"), F.length("other"))
    most = F.when(least >= F.when(F.col("space") == "r", 8).otherwise(6), 2).when(least >= 4, 1).otherwise(0)
    near = near.where(F.col("d") <= most)
    listed_keys = other.select("space", F.col("key").alias("other"), F.col("core").alias("e_core"), F.col("hebrew").alias("e_hebrew"))
    met = near.join(one, ["space", "key"]).join(listed_keys, ["space", "other"])
    met = met.where((F.col("space") == "r") | F.col("hebrew") | F.col("e_hebrew"))
    return met.groupBy("core", "e_core").agg(F.min("d").alias("far"))


def candidates(typed: DataFrame, entities: DataFrame, id_column: str, name_columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(name, entity, far, jaccard) of distinct names (column name) and the entities that they may mean.

    The generic words, their translations and weights are learned from all names of the list. far are the edits between
    the cores. An entity whose concepts don't include all those of the name is none it may mean.
    """
    learned = lexicon.learned(entities, name_columns)
    listed = written(
        entities.select(F.col(id_column).alias("entity"), F.explode(F.array(*name_columns)).alias("name"))
        .where(F.length(F.trim("name")) > 0)
        .distinct()
    )
    read_list = written(lexicon.read_names(listed.select("name").distinct(), learned).where("not void"))
    read_typed = lexicon.with_acronyms(lexicon.read_names(typed, learned).where("not void"), lexicon.acronym_table(read_list, learned))
    read_typed = written(read_typed)
    near = near_cores(read_typed, read_list)
    core_of = F.struct(F.concat(F.lit("="), F.col("e_core")).alias("token"), F.lit(learned.core_weight).alias("weight"))
    whole = F.when(F.col("e_core") == "", F.col("tokens")).otherwise(F.concat(F.array(core_of), F.col("tokens")))
    label = F.concat_ws("\u0001", "e_core", F.array_join("concepts", "\u0002"))
    # a set per core of the list and concepts, however many names have it
    mended = read_typed.where("core <> ''").join(near, "core").unionByName(
        read_typed.where("core = ''").select("*", F.lit("").alias("e_core"), F.lit(0).alias("far"))
    )
    mended = written(mended.select("name", "far", "concepts", "tokens", "e_core", label.alias("id")))
    of_list = written(read_list.withColumn("e_core", F.col("core")).select("name", "concepts", "tokens", "e_core", label.alias("id")))
    sets = lambda rows: rows.select("id", whole.alias("tokens")).dropDuplicates(["id"])
    similar = set_similarity_join(sets(mended), sets(of_list), threshold)
    core = lambda c: F.substring_index(c, "\u0001", 1)
    concepts = lambda c: F.split(F.substring_index(c, "\u0001", -1), "\u0002")
    # the exact check after it: one core, and no concept that the entity lacks
    fit = similar.where(
        (core("left_id") == core("right_id")) & (F.size(F.filter(F.array_except(concepts("left_id"), concepts("right_id")), lambda c: c != "")) == 0)
    )
    entities_of = of_list.select(F.col("id").alias("right_id"), "name").join(listed, "name").select("right_id", "entity").distinct()
    found = mended.select("name", "far", F.col("id").alias("left_id")).join(fit, "left_id").join(entities_of, "right_id")
    best = F.min(F.struct("far", (-F.col("jaccard")).alias("less")))  # of the names of an entity the one that fits best
    return found.groupBy("name", "entity").agg(best.alias("b")).select("name", "entity", "b.far", (-F.col("b.less")).alias("jaccard"))


def linked(
    rows: DataFrame,
    id_column: str,
    typed_column: str,
    hint_column: str | None,
    entities: DataFrame,
    entity_id: str,
    name_columns: list[str],
) -> DataFrame:
    """(id_column, entity_id): the entity that the typed name of each row means, -1 if none.

    Rows whose typed name is null or blank don't come out. Of the entities that the name may mean, those with the fewest edits
    in the core stay, and of these the one of the greatest Jaccard similarity is meant; but where the hint column, typed
    freely as well, singles out one of those that stay, that one. A tie that remains means none. Rows may
    repeat; an empty list of entities maps everything to -1; other columns are ignored.
    """
    hint = F.col(hint_column) if hint_column else F.lit(None).cast("string")
    blank = lambda c: F.length(F.regexp_replace(c, r"[\s\p{Z}]+", "")) == 0
    asked = rows.select(F.col(id_column).alias("id"), F.col(typed_column).alias("name"), hint.alias("hint"))
    asked = written(asked.where(F.col("name").isNotNull() & ~blank(F.col("name"))))
    typed = asked.select(F.explode(F.array("name", "hint")).alias("name")).where(F.col("name").isNotNull() & ~blank(F.col("name")))
    found = candidates(typed.distinct(), entities, entity_id, name_columns)
    # of each name the best candidates, ties included
    by_core = Window.partitionBy("name").orderBy("far")
    by_all = Window.partitionBy("name").orderBy("far", F.desc(F.round("jaccard", 9)))
    found = found.withColumn("core_rank", F.rank().over(by_core)).withColumn("rank", F.rank().over(by_all))
    found = written(found.select("name", "entity", "core_rank", "rank"))
    best = found.where("core_rank = 1").groupBy("name").agg(  # entities of one core, a few
        F.collect_set("entity").alias("best"), F.collect_set(F.when(F.col("rank") == 1, F.col("entity"))).alias("first")
    )
    hinted = found.groupBy(F.col("name").alias("hint")).agg(F.collect_list(F.struct("rank", "entity")).alias("hinted"))
    pairs = asked.select("name", "hint").distinct().join(best, "name", "left").join(hinted, "hint", "left")
    pairs = computed_once(pairs, "_agreed", F.filter("hinted", lambda h: F.array_contains("best", h["entity"])))
    lowest = F.array_min(F.transform("_agreed", lambda h: h["rank"]))
    pairs = computed_once(pairs, "_chosen", F.filter("_agreed", lambda h: h["rank"] == lowest))
    one = (
        F.when(F.size("best") == 1, F.get("best", F.lit(0)))
        .when(F.size("_chosen") == 1, F.get("_chosen", F.lit(0))["entity"])
        .when(F.size("first") == 1, F.get("first", F.lit(0)))
        .otherwise(F.lit(-1))
    )
    meant = pairs.select("name", "hint", F.coalesce(one, F.lit(-1)).cast("long").alias("meant"))
    right = meant.select(F.col("name").alias("n2"), F.col("hint").alias("h2"), "meant")
    joined = asked.join(right, (F.col("name") == F.col("n2")) & F.col("hint").eqNullSafe(F.col("h2")), "left")
    return joined.select(F.col("id").alias(id_column), F.coalesce("meant", F.lit(-1).cast("long")).alias("entity_id"))
