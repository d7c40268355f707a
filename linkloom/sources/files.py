"""Readers and writers of the pipeline's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: White space at the ends of values is part of them, and line ends within quoted values stay as they are.
_AS_WRITTEN = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n"}


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, header: bool = True) -> DataFrame:
    """CSV files of one or several paths or patterns, quoted fields over several lines allowed; strings without a schema."""
    reader = spark.read.option("header", header).option("multiLine", True).option("encoding", "UTF-8").options(**_AS_WRITTEN)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(term1, term2) of a CSV file without header."""
    return read_csv(spark, path, "term1 string, term2 string", header=False)


def read_named_files(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """All CSV files under a folder, at any depth, with file_stem: their names without the ending."""
    reader = spark.read.option("header", True).option("multiLine", True).options(**_AS_WRITTEN).option("recursiveFileLookup", True)
    rows = reader.option("pathGlobFilter", "*.csv").schema(schema).csv(folder)
    return rows.withColumn("file_stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1))


def read_documents(spark: SparkSession, path: str, end_of_document: str, end_of_url: str) -> DataFrame:
    """(url, text) of files of documents between marks; what follows the last mark isn't a document."""
    chunks = spark.read.option("lineSep", end_of_document).text(path)
    parts = F.split("value", F.concat(F.lit("\\Q"), F.lit(end_of_url), F.lit("\\E")), 2)
    found = chunks.where(F.col("value").contains(end_of_url)).select(parts.alias("p"))
    return found.select(F.trim(F.regexp_replace(F.get("p", F.lit(0)), r"^\s+|\s+$", "")).alias("url"), F.get("p", F.lit(1)).alias("text"))


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, lines: bool = False) -> DataFrame:
    """Files of JSON, one value each, or with lines a value per line, which splits large files."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_column(spark: SparkSession, path: str, key: str = "term", separator: str = ",") -> DataFrame:
    """One column of a simple delimited file without quoting; rows that are too short are skipped."""
    rows = spark.read.option("header", True).option("sep", separator).option("quote", "").option("mode", "PERMISSIVE").csv(path)
    return rows.select(key).where(F.col(key).isNotNull())


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term): the trimmed, non-empty, distinct lines of a text file."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term <> ''").distinct()


def snapshot_urls(index: DataFrame, timestamp: str = "timestamp", original: str = "original", prefix: str = "", since: str | None = None, till: str | None = None) -> DataFrame:
    """(url) of an archive's index: prefix, time stamp and original address; of time stamps from since to till, both included."""
    if since is not None:
        index = index.where(F.col(timestamp) >= since)
    if till is not None:
        index = index.where(F.col(timestamp) <= till)
    return index.select(F.concat(F.lit(prefix), F.col(timestamp), F.lit("/"), F.col(original)).alias("url"))


def read_type_map(spark: SparkSession, path: str) -> DataFrame:
    """(sub_type, type) of a JSON file of one object whose keys are sub-types."""
    whole = spark.read.option("wholetext", True).text(path)
    pairs = F.explode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("e")
    return whole.select(pairs).select(F.col("e.key").alias("sub_type"), F.col("e.value").alias("type"))


def approved(terms: DataFrame, term: str, labels: DataFrame) -> DataFrame:
    """The terms that a table of labels (term, label) marks with y."""
    yes = labels.where(F.lower(F.trim("label")) == "y").select(F.col("term").alias(term)).distinct()
    return terms.join(yes, term, "left_semi")


def write_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).option("header", True).options(**_AS_WRITTEN).csv(path)


def write_by_year(rows: DataFrame, path: str, date: str, mode: str = "error") -> None:
    """Parquet files in a folder per year, the last four characters of the date; rows are gathered by year and spread within it."""
    with_year = rows.withColumn("year", F.right(F.col(date), F.lit(4)))
    with_year.write.mode(mode).partitionBy("year").parquet(path)


def write_table(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).parquet(path)


def append_documents(rows: DataFrame, path: str, end_of_document: str, end_of_url: str, url: str = "url", text: str = "text") -> None:
    """Append documents to a log of texts that read_documents reads."""
    lines = rows.select(F.concat(F.col(url), F.lit(end_of_url), F.coalesce(text, F.lit("")), F.lit(end_of_document)).alias("value"))
    lines.write.mode("append").option("lineSep", "\n").text(path)


def long_table(sets: DataFrame, key: str, values: str, value_name: str) -> DataFrame:
    """One row per key and element of its list, the elements trimmed."""
    return sets.select(key, F.explode(values).alias("_v")).select(key, F.trim("_v").alias(value_name))
