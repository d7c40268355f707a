"""Records that are the same but for whitespace, case, punctuation and field order.

Byte-identical rows are collapsed first, with counts; only the distinct survivors are
canonicalised, and these are grouped again on their whole canonical text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.runtime import written

#: Ids of byte-identical rows are kept in lists of at most about this many.
CHUNK = 1 << 16
#: Rows of a table that is broadcast.
SMALL = 100_000

#: Quote-like characters written inside words (abbreviations), dropped and not read as a space.
INNER_QUOTES = "['\"`´‘’‚‛“”„‟′″׳״]"


def canonical(field: Column) -> Column:
    """The words of a text in lower case, sorted, single spaces between; null stays null.

    Words are runs of letters, marks and digits; quote-like characters inside a word are dropped.
    """
    bare = F.regexp_replace(F.lower(field), INNER_QUOTES, "")
    words = F.split(F.trim(F.regexp_replace(bare, r"[^\p{L}\p{M}\p{N}]+", " ")), " ")
    return F.array_join(F.array_sort(words), " ")


def collapsed(rows: DataFrame, id_column: str, exact: Sequence[str], loose: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """(_e0 ..., _l0 ..., _part, _ids): the distinct raw rows with the ids of each.

    A raw row of more than chunk ids is several rows that differ in _part. Rows with a null in `exact` or the id are left out.
    """
    keep = rows.select(
        F.col(id_column).cast("long").alias("_id"),
        *[F.col(c).alias(f"_e{k}") for k, c in enumerate(exact)],
        *[F.col(c).alias(f"_l{k}") for k, c in enumerate(loose)],
    )
    e = [f"_e{k}" for k in range(len(exact))]
    raw = [*e, *[f"_l{k}" for k in range(len(loose))]]
    for c in [*e, "_id"]:
        keep = keep.where(F.col(c).isNotNull())
    # raw rows that are too many for one list are found by their hash, of which all rows are counted
    raw_hash = F.xxhash64(*raw)
    often = written(keep.groupBy(raw_hash.alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk))
    hot = often.limit(SMALL + 1).count()
    part = F.lit(0)
    if hot:
        side = F.broadcast(often) if hot <= SMALL else often
        keep = keep.withColumn("_h", raw_hash).join(side, "_h", "left").drop("_h")
        part = F.when(F.col("_n") > chunk, F.pmod(F.xxhash64("_id"), F.ceil(F.col("_n") / chunk))).otherwise(0)
    return keep.groupBy(*raw, part.alias("_part")).agg(F.collect_set("_id").alias("_ids"))


def formatting_copies(
    rows: DataFrame,
    id_column: str,
    exact: Sequence[str],
    loose: Sequence[str],
    strict_null: Sequence[str] = (),
    chunk: int = CHUNK,
) -> DataFrame:
    """Copies of records as (first_id, copy_id, copies), one row per copy other than the first.

    Two rows are copies if the columns `exact` are equal and not null and the columns
    `loose` say the same apart from whitespace, case, punctuation, the order of words and
    the order of the `loose` columns. In a column of `strict_null`, null equals only null;
    in the other loose columns null and a text without letters and digits are the same.
    copies is the number of rows of the record, the first one included. Rows with a null in
    `exact` are copies of nothing; repeated ids count as one row. Other columns are ignored.

    No group is brought to one task: byte-identical rows become one row with the list of their ids, or,
    if they are more than `chunk`, which is counted first, as many rows as keep the lists that long; the
    groupings combine before they shuffle, and the join back, on the md5 of the record, may be split for skew.
    """
    e = [f"_e{k}" for k in range(len(exact))]
    survivors = collapsed(rows, id_column, exact, loose, chunk)
    nulls = [F.col(f"_l{k}").isNull().cast("string") for k, c in enumerate(loose) if c in strict_null]
    parts = F.array_sort(F.array(*[F.coalesce(canonical(F.col(f"_l{k}")), F.lit("")) for k in range(len(loose))]))
    text = F.concat_ws("\u0001", *nulls, parts)
    survivors = survivors.select(*e, text.alias("_text"), "_ids")
    digest = F.unhex(F.md5(F.concat_ws("\u0002", *e, "_text"))).alias("_key")
    records = (
        survivors.groupBy(*e, "_text")
        .agg(F.min(F.array_min("_ids")).alias("_first"), F.sum(F.size("_ids")).alias("copies"))
        .where("copies > 1")
        .select(digest, "_first", "copies")
    )
    return (
        survivors.select(digest, "_ids")
        .join(records, "_key")
        .select("_first", F.explode("_ids").alias("_copy"), "copies")
        .where("_copy <> _first")
        .select(F.col("_first").alias("first_id"), F.col("_copy").alias("copy_id"), "copies")
    )
