"""The register of entities of several sources, their hierarchy, and names linked to it by containment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import similarity
from linkloom.functions.text import has_hebrew

#: Names of one column in different registries, the first that a registry has is used.
ID_COLUMNS = ("id", "Association_Number")
NAME_COLUMNS = ("name", "company_name", "Association_Name")
ENGLISH_COLUMNS = ("name_en", "company_name_eng")
KIND_COLUMNS = ("kind", "company_type")


def _first_of(rows: DataFrame, names: Sequence[str], default: str | None) -> Column:
    for name in names:
        if name in rows.columns:
            return F.col(name)
    return F.lit(default)


def _true(rows: DataFrame, name: str) -> Column:
    """Whether a flag is set, written as a boolean or as a text."""
    return F.coalesce(F.lower(F.col(name).cast("string")) == "true", F.lit(False)) if name in rows.columns else F.lit(False)


def registry(rows: DataFrame, rank: int, kind: str | None = None) -> DataFrame:
    """(id, type, name, name_eng, source_rank, row_no) of one registry, whatever its columns are called.

    The type is the registry's own kind, else the one given, else municipal, government or
    private by its flags. A missing English name is ''.
    """
    own = _first_of(rows, KIND_COLUMNS, kind)
    flagged = F.when(_true(rows, "company_is_municipal"), "municipal").when(_true(rows, "company_is_government"), "government").otherwise("private")
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    return numbered.select(
        _first_of(rows, ID_COLUMNS, None).cast("long").alias("id"),
        F.coalesce(own, flagged).alias("type"),
        _first_of(rows, NAME_COLUMNS, None).alias("name"),
        F.coalesce(_first_of(rows, ENGLISH_COLUMNS, None), F.lit("")).alias("name_eng"),
        F.lit(rank).alias("source_rank"),
        F.col("_row").alias("row_no"),
    )


def first_by_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Of each key the first row in an order; rows with a null key are dropped."""
    least = Window.partitionBy(key).orderBy(*order)
    return rows.where(F.col(key).isNotNull()).withColumn("_k", F.row_number().over(least)).where("_k = 1").drop("_k")


def entity_database(registries: Sequence[DataFrame]) -> DataFrame:
    """(id, type, name, name_eng): of each id the first row over all registries in their order."""
    whole = registries[0]
    for rows in registries[1:]:
        whole = whole.unionByName(rows)
    return first_by_key(whole, "id", ["source_rank", "row_no"]).select("id", "type", "name", "name_eng")


def first_spelling(rows: DataFrame, fingerprint: str, spelling: str, order: str) -> DataFrame:
    """rows with the spelling that comes first among those of one fingerprint."""
    first = rows.groupBy(fingerprint).agg(F.min_by(spelling, F.struct(order, spelling)).alias("_first"))
    return rows.join(first, fingerprint).withColumn(spelling, F.col("_first")).drop("_first").select(rows.columns)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: F.length(w) > 0)


def containing_entities(typed: DataFrame, entities: DataFrame) -> DataFrame:
    """(org_name, id, name, name_eng) of entities whose name has the typed name in it, bounded by word ends.

    Hebrew names are looked up in name, others in name and name_eng, whatever their case. Entities meet typed names at
    the typed name's rarest word only, so that frequent words make no large groups.
    """
    spelled = entities.select("id", "name", "name_eng", F.explode(F.array("name", "name_eng")).alias("where_"))
    spelled = spelled.where("where_ is not null").distinct()
    tokens = spelled.select("id", "name", "name_eng", "where_", F.explode(F.array_distinct(_words(F.col("where_")))).alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    asked = typed.select("org_name").where("org_name is not null").distinct()
    words = asked.select("org_name", F.explode(F.array_distinct(_words(F.col("org_name")))).alias("token")).join(often, "token", "left")
    rarest = words.groupBy("org_name").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token"))["token"].alias("token"))
    met = rarest.join(tokens, "token")
    padded = lambda c: F.concat(F.lit(" "), F.array_join(_words(c), " "), F.lit(" "))
    inside = padded(F.col("where_")).contains(padded(F.col("org_name")))
    return met.where(inside).select("org_name", "id", "name", "name_eng").distinct()


def link_entities(typed: DataFrame, entities: DataFrame, types: Column, overrides: DataFrame | None = None) -> DataFrame:
    """(org_name, entity_name, id, type, sub_type, score): of each typed name the best of the entities that contain it.

    The score is the token-sort ratio with the name of the same script, ties go to the least id. overrides
    (name, official_name) replaces typed names first. A name without a candidate keeps itself with
    id -1: type company and score infinity if it was overridden, else other and minus infinity.
    types: expression of the type over the column sub_type.
    """
    asked = typed.select("org_name").where("org_name is not null").distinct()
    if overrides is not None:
        official = overrides.groupBy(F.col("name").alias("org_name")).agg(F.min("official_name").alias("official"))
        asked = asked.join(official, "org_name", "left")
    else:
        asked = asked.withColumn("official", F.lit(None).cast("string"))
    asked = asked.withColumn("search", F.coalesce("official", "org_name"))
    found = containing_entities(asked.select(F.col("search").alias("org_name")), entities).withColumnRenamed("org_name", "search")
    other = F.when(has_hebrew(F.col("search")), F.col("name")).otherwise(F.coalesce(F.col("name_eng"), F.col("name")))
    scored = found.withColumn("score", similarity.token_sort(F.least("search", other), F.greatest("search", other)))
    scored = scored.join(entities.select("id", F.col("type").alias("sub_type")), "id")
    best = scored.groupBy("search").agg(F.max_by(F.struct("id", "name", "sub_type", "score"), F.struct("score", -F.col("id"))).alias("b"))
    joined = asked.join(best, "search", "left").withColumn("sub_type", F.col("b.sub_type"))
    none, over = F.col("b").isNull(), F.col("official").isNotNull()
    return joined.select(
        "org_name",
        F.coalesce("b.name", "org_name").alias("entity_name"),
        F.coalesce("b.id", F.lit(-1).cast("long")).alias("id"),
        F.when(none, F.when(over, "company").otherwise("other")).otherwise(types).alias("type"),
        "sub_type",
        F.when(none, F.when(over, float("inf")).otherwise(float("-inf"))).otherwise(F.col("b.score").cast("double")).alias("score"),
    )


def best_of_merge_set(links: DataFrame, members: DataFrame) -> DataFrame:
    """Of each organization (organization, member) the best-scored link of its members, under its own name."""
    joined = members.join(links.withColumnRenamed("org_name", "member"), "member")
    columns = [c for c in links.columns if c != "org_name"]
    best = joined.groupBy("organization").agg(F.max_by(F.struct(*columns), F.struct("score", -F.col("id"))).alias("b"))
    return best.select(F.col("organization").alias("org_name"), *[F.col("b")[c].alias(c) for c in columns])


def types_histogram(links: DataFrame, dataset: str) -> DataFrame:
    """(sub_type, dataset, n) of linked names, those without a known sub-type left out."""
    counted = links.where("sub_type is not null and sub_type <> 'other'").groupBy("sub_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("sub_type", F.lit(dataset).alias("dataset"), "n")
