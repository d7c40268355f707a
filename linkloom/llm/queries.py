"""The pN_ queries of the operators in this folder, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import components, copies, linking, oracles, packing, sentences, together, tokens, variants


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    entities = _table(spark, folder, "entity_database")
    rows = _table(spark, folder, "org_entity_matches")
    return linking.linked(rows, "match_id", "org_name", "entity_name", entities, "id", ["name", "name_eng"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = copies.formatting_copies(
        _table(spark, folder, "guests"),
        "guest_id",
        exact=["meeting_id", "full_name"],
        loose=["company", "job_title"],
        strict_null=["job_title"],
    )
    return found.select(F.col("first_id").alias("first_guest_id"), F.col("copy_id").alias("guest_id"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.components(_table(spark, folder, "merge_pairs"), "term1", "term2")


def _spelled(names: DataFrame) -> DataFrame:
    return names.where("name is not null").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    guests = _table(spark, folder, "guests")
    organisations = guests.select(F.col("raw_company").alias("name")).unionByName(
        _table(spark, folder, "article_baskets").select(F.col("organization").alias("name"))
    )
    people = _spelled(guests.select(F.col("full_name").alias("name")))
    of_people, of_organisations = variants.resolved(
        variants.person_steps(people, _table(spark, folder, "nicknames")),
        variants.organisation_steps(_spelled(organisations), _table(spark, folder, "entity_database"), ["name", "name_eng"]),
    )
    pairs = variants.spelling_pairs(of_people).select(F.lit("person").alias("kind"), "name_a", "name_b")
    return pairs.unionByName(
        variants.spelling_pairs(of_organisations).select(F.lit("organisation").alias("kind"), "name_a", "name_b")
    )


def _baskets(spark: SparkSession, folder: str) -> DataFrame:
    meetings = _table(spark, folder, "guests").select(
        F.lit("meeting").alias("kind"),
        F.col("meeting_id").alias("basket"),
        together.letters_and_digits(F.col("company")).alias("item"),
    )
    articles = _table(spark, folder, "article_baskets").select(
        F.lit("article").alias("kind"),
        F.col("article").alias("basket"),
        together.letters_and_digits(F.col("organization")).alias("item"),
    )
    return meetings.unionByName(articles)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = together.items_together(_baskets(spark, folder), "kind", "basket", "item", min_together=6, min_lift=8)
    return pairs.select(F.col("kind").alias("basket"), "item_a", "item_b")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(_table(spark, folder, "documents"), "doc_id", "text")


#: Tokens that a container of p8_packed holds.
CAPACITY = 2048


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    sizes = tokens.token_counts(_table(spark, folder, "documents"), "doc_id", "text")
    return packing.packed(sizes, "doc_id", "n_tokens", CAPACITY)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    units = sentences.sentence_units(_table(spark, folder, "documents"), "doc_id", "text", with_text=False)
    return units.select("doc_id", "start_char", "end_char")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_ids": p7_ids, "p8_packed": p8_packed, "p9_found": p9_found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
