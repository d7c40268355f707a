"""Text columns: cleaners, parsers of roster rows, titles, links, dates and packed jobs.

All patterns know letters of any script; null in gives null out unless a docstring says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any_of(terms: Sequence[str]) -> str:
    """A pattern of literal terms, longest first, for the JVM."""
    return "|".join(re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", t) for t in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)))


def without_leading_terms(text: Column, terms: Sequence[str]) -> Column:
    """text without its leading words that begin with one of the terms; '' if that is all of it."""
    if not any(terms):
        return text
    starts = _any_of(terms)
    rest = F.regexp_replace(text, rf"(?U)^(?:(?:{starts})\S*\s+)+", "")
    return F.when(rest.rlike(rf"(?U)^(?:{starts})\S*$"), "").otherwise(rest)


def split_off_terms(text: Column, terms: Sequence[str]) -> Column:
    """A struct (found, rest): the first of the terms that the text has, the longest at its place, and the text without it."""
    if not any(terms):
        return F.struct(F.lit("").alias("found"), text.alias("rest"))
    pattern = f"({_any_of(terms)})"
    found = F.regexp_extract(text, pattern, 1)
    before = F.regexp_extract(text, f"(?s)^(.*?){pattern}(.*)$", 1)
    after = F.regexp_extract(text, f"(?s)^(.*?){pattern}(.*)$", 3)
    rest = F.when(F.length(found) > 0, F.trim(F.concat(before, after))).otherwise(text)
    return F.struct(found.alias("found"), rest.alias("rest"))


def without_token_quotes(text: Column) -> Column:
    """Every space-separated token without double quotes at its ends."""
    return F.array_join(F.transform(F.split(text, " "), lambda t: F.regexp_replace(t, '^"+|"+$', "")), " ")


#: Fixed value: what separates the parts of a roster row.
ROW_PARTS = r"(?U),|\s-\s|\s–\s"


def row_parts(row: Column) -> Column:
    """The trimmed parts of a roster row; if a comma stands before the first dash, the last part comes first."""
    parts = F.transform(F.split(row, ROW_PARTS), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    comma = F.instr(row, ",")
    dash = F.when(row.rlike(r"(?U)\s[-–]\s"), F.length(F.regexp_extract(row, r"(?U)^(.*?)\s[-–]\s", 1)) + 1).otherwise(0)
    turned = (comma > 0) & (dash > 0) & (comma < dash) & (F.size(parts) > 1)
    moved = F.concat(F.slice(parts, -1, 1), F.slice(parts, F.lit(1), F.size(parts) - 1))
    return F.when(turned, moved).otherwise(parts)


def is_guest_row(row: Column) -> Column:
    """Whether a line looks like a guest: a spaced dash or more than two commas, no colon, not empty."""
    dashed = row.rlike(r"(?U)\s[-–]\s")
    return (dashed | (F.size(F.split(row, ",")) > 2)) & (F.length(F.trim(row)) > 0) & ~row.contains(":")


def person_tokens(text: Column, first_names: Sequence[str], last_names: Sequence[str], titles: Sequence[str] = ()) -> Column:
    """A struct (full_name, job_title, valid) of the words before the first separator of a roster row.

    The name begins with the first word that is a first name; later words belong to it if they
    are last names or hyphenated; the other words are the job title. Valid if a first name or a title was found.
    """
    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda t: F.length(t) > 0)
    firsts, lasts, known = F.array(*map(F.lit, first_names)), F.array(*map(F.lit, last_names)), F.array(*map(F.lit, titles))
    start = F.array_position(F.transform(tokens, lambda t: F.array_contains(firsts, t)), True)
    indexed = F.transform(tokens, lambda t, k: F.struct(t.alias("t"), (k + 1).alias("k")))
    in_name = lambda x: (start > 0) & (
        (x["k"] == start) | ((x["k"] > start) & (F.array_contains(lasts, x["t"]) | x["t"].contains("-")))
    )
    name = F.transform(F.filter(indexed, in_name), lambda x: x["t"])
    title = F.transform(F.filter(indexed, lambda x: ~in_name(x)), lambda x: x["t"])
    has_title = F.exists(tokens, lambda t: F.array_contains(known, t)) if titles else F.lit(False)
    return F.struct(
        F.array_join(name, " ").alias("full_name"), F.array_join(title, " ").alias("job_title"), ((start > 0) | has_title).alias("valid")
    )


def guest_rows(
    lines: DataFrame,
    line: str,
    first_names: Sequence[str],
    last_names: Sequence[str],
    titles: Sequence[str],
    cleaning_terms: Sequence[str],
    lobby_terms: Sequence[str],
) -> DataFrame:
    """Rosters' lines parsed: the other columns, full_name, job_title, company and raw_company.

    Lines that are no guests, have one part or no valid name, or leave no work place, are dropped.
    Spaces in job titles are collapsed.
    """
    kept = [c for c in lines.columns if c not in {line, "full_name", "job_title", "company", "raw_company"}]
    parts = lines.where(is_guest_row(F.col(line))).select(*kept, row_parts(F.col(line)).alias("_parts")).where(F.size("_parts") >= 2)
    named = parts.withColumn("_name", person_tokens(F.get("_parts", F.lit(0)), first_names, last_names, titles)).where("_name.valid")
    split = named.withColumn("_lobby", split_off_terms(F.element_at("_parts", -1), lobby_terms))
    middle = F.when(F.size("_parts") > 2, F.get("_parts", F.lit(1))).otherwise("")
    title = F.trim(F.regexp_replace(F.concat_ws(" ", "_name.job_title", middle, "_lobby.found"), r"(?U)\s+", " "))
    raw = F.col("_lobby.rest")
    company = without_token_quotes(without_leading_terms(raw, cleaning_terms))
    found = split.select(*kept, F.col("_name.full_name").alias("full_name"), title.alias("job_title"), company.alias("company"), raw.alias("raw_company"))
    return found.where(F.length(F.trim("company")) > 0)


def substring_count(text: Column, part: Column) -> Column:
    """How often a part occurs in a text, without overlaps; 0 for an empty part."""
    many = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)
    return F.when(F.length(part) > 0, many).otherwise(0).cast("long")


def last_segment(text: Column, separator: str) -> Column:
    """What follows the last separator; the whole text if there is none."""
    return F.substring_index(text, separator, -1)


def has_hebrew(text: Column) -> Column:
    return text.rlike("[֐-׿]")


def display_order(text: Column) -> Column:
    """Hebrew texts reversed for displays that write from left to right; other texts as they are."""
    return F.when(has_hebrew(text), F.reverse(text)).otherwise(text)


def looked_up_title(name: Column, country: str) -> Column:
    """The title to look a body up by: ministries with their country, without a leading article."""
    lowered = F.lower(F.trim(name))
    full = F.when(lowered.startswith("ministry"), F.concat(lowered, F.lit(f" ({country})"))).otherwise(lowered)
    return F.regexp_replace(full, "^the ", "")


def hierarchy(rows: DataFrame, name: str, article: str = "ה") -> DataFrame:
    """rows whose name has a slash, with parent and child: what stands before it, at a hyphen first, and the rest.

    The fingerprint of a parent, its name without a leading article, is the same for both spellings.
    """
    pieces = F.split(F.regexp_replace(F.col(name), r"^([^/-]*)-", "$1/"), "/")
    parts = rows.where(F.col(name).contains("/")).withColumn("_p", F.transform(pieces, lambda p: F.trim(p)))
    child = F.array_join(F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0))), "/")
    split = parts.withColumn("parent", F.get("_p", F.lit(0))).withColumn("child", child).drop("_p")
    return split.withColumn("fingerprint", F.regexp_replace("parent", f"^{article}", ""))


def mapped_type(sub_type: Column, types: dict[str, str], default: str = "other") -> Column:
    """The type of a sub-type; the default for null and for unknown ones."""
    if not types:
        return F.lit(default)
    pairs = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return F.coalesce(F.get(F.array(pairs[sub_type]), F.lit(0)), F.lit(default))


def with_mapped_type(rows: DataFrame, sub_type: str, types: DataFrame, name: str = "type", default: str = "other") -> DataFrame:
    """rows with the type of their sub-type by a table (sub_type, type) of any size; the default for null and unknown ones."""
    one = types.groupBy(F.col("sub_type").alias("_s")).agg(F.min("type").alias("_t"))
    joined = rows.join(one, F.col(sub_type) == F.col("_s"), "left")
    return joined.withColumn(name, F.coalesce("_t", F.lit(default))).drop("_s", "_t")


def year_of(date: Column) -> Column:
    """The last four characters of a date text."""
    return F.right(date, F.lit(4))


def days_down(spark, since: str, till: str, step: int = 1) -> DataFrame:
    """(day): dates from `since` down to `till` as yyyyMMdd, one every `step` days."""
    dates = F.sequence(F.to_date(F.lit(since)), F.to_date(F.lit(till)), F.expr(f"interval -{int(step)} day"))
    return spark.range(1).select(F.explode(dates).alias("d")).select(F.date_format("d", "yyyyMMdd").alias("day"))


def triples(text: Column) -> Column:
    """The complete entries (role, company, duration) of a text `(role##company##duration),...`; others are left out."""
    entries = F.transform(F.split(text, ","), lambda e: F.split(F.regexp_replace(F.trim(e), r"^\(+|\)+$", ""), "##"))
    whole = F.filter(entries, lambda e: F.size(e) == 3)
    return F.transform(whole, lambda e: F.struct(e[0].alias("role"), e[1].alias("company"), e[2].alias("duration")))


def exploded(rows: DataFrame, column: str, name: str, outer: bool = False) -> DataFrame:
    """One row per element of an array column; with outer a row with null for an empty or null array."""
    rest = [c for c in rows.columns if c not in {column, name}]
    return rows.select(*rest, (F.explode_outer if outer else F.explode)(column).alias(name))
