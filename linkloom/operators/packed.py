"""Fields that hold several records, each of several values, between delimiters that vary from row to row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.columns import computed_once

#: Candidates for what stands between the values of a record, and between records.
VALUE_DELIMITERS = ("##", "::", "~", "#", "\t")
RECORD_DELIMITERS = (",", ";", "|", "/", "\n")

#: Characters that quoting or a backslash makes ordinary; they travel as private-use characters.
SPECIAL = ",;|/\n()[]{}#:~\t\"'\\“”«»‘’"
MASKED = "".join(chr(0xE100 + k) for k in range(len(SPECIAL)))
OPEN, CLOSE = "\ue000", "\ue001"

#: Fixed value: how the last value of a record begins, a span of time.
SPAN = r"^\s*(?:\p{N}|(?:since|until|from)\b|\p{L}{3,9}\.? \p{N}{4}|שנ|חודש)"

#: White space, with and without line ends and tabs, which may delimit.
_BLANK = r"[ \x0B\f\r\u00a0\u2000-\u200b\u202f\u205f\u3000\ufeff]"
_SPACE = r"[\s   -​    　﻿]"


def stripped(text: Column) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def masked(text: Column) -> Column:
    """text without its quoting and escaping; special characters that these covered are private-use ones.

    A quoted value reaches from delimiter to delimiter, so that a quote inside a value, as in
    an abbreviation, is an ordinary character; a doubled quote within one stands for the quote.
    """
    escaped = reduce(lambda t, k: F.replace(t, F.lit("\\" + SPECIAL[k]), F.lit(MASKED[k])), range(len(SPECIAL)), text)
    quoted = "\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'|“[^”]*”|«[^»]*»|‘[^’]*’"
    marked = F.regexp_replace(
        escaped,
        rf"(?<=^|[(\[{{,;|/\n#~\t]|::){_BLANK}*({quoted}){_BLANK}*(?=$|[)\]}},;|/\n#~\t]|::)",
        f"{OPEN}$1{CLOSE}",
    )
    parts = F.split(marked, f"[{OPEN}{CLOSE}]")

    def plain(part: Column, place: Column) -> Column:
        inner = F.substring(part, F.lit(2), F.greatest(F.length(part) - 2, F.lit(0)))
        undoubled = F.replace(F.replace(inner, F.lit('""'), F.lit('"')), F.lit("''"), F.lit("'"))
        return F.when(place % 2 == 1, F.translate(undoubled, SPECIAL, MASKED)).otherwise(part)

    return F.when(marked.contains(OPEN), F.array_join(F.transform(parts, plain), "")).otherwise(escaped)


def unmasked(text: Column) -> Column:
    return F.translate(text, MASKED, SPECIAL)


#: Stands for the record delimiter once that is known.
_CUT = "\ue002"


def _records(text: Column, between: Column, most: int) -> Column:
    """text, split at any character of `between`."""
    return F.split(F.call_function("translate", text, between, F.lit(_CUT * most)), _CUT)


def _candidate(text: Column, c: Column, values: int, most: int) -> Column:
    """(score, order, value delimiter, record delimiters) of a candidate.

    The score is the share of non-empty records of 2 to `values` pieces, the regularity (in
    how many records with all values the last looks like a span of time or is empty), and a
    little for finding more records.
    """
    d = c["d"]
    records = F.filter(
        _records(text, c["b"], most), lambda r: F.length(stripped(F.replace(r, d, F.lit("")))) > 0
    )
    judged = F.transform(
        records,
        lambda r: F.struct(
            (1 + (F.length(r) - F.length(F.replace(r, d, F.lit("")))) / F.length(d)).cast("int").alias("n"),
            F.call_function("substring_index", r, d, F.lit(-1)).alias("last"),
        ),
    )

    def score(js: Column) -> Column:
        fit = F.size(F.filter(js, lambda j: (j["n"] >= 2) & (j["n"] <= values)))
        span = lambda j: j["last"].rlike(f"(?i){SPAN}") | (F.length(stripped(j["last"])) == 0)
        regular = F.size(F.filter(js, lambda j: (j["n"] == values) & span(j)))
        return F.coalesce(F.try_divide(2 * fit + regular, F.size(js)) + fit * 0.001, F.lit(-1.0))

    scored = F.transform(F.array(judged), score)[0]  # in a list of one, so that it is judged once
    return F.struct(scored.alias("score"), (-c["k"]).alias("order"), d.alias("d"), c["b"].alias("b"))


def split_packed(
    rows: DataFrame,
    column: str,
    values: Sequence[str],
    position: str = "pos",
    value_delimiters: Sequence[str] = VALUE_DELIMITERS,
    record_delimiters: Sequence[str] = RECORD_DELIMITERS,
) -> DataFrame:
    """One row per record of a packed field: the other columns, its position from 1, and its values.

    Every row is a source of its own: candidates for the delimiters are scored on how many
    records come out with a fitting number of pieces, and on how many of the last pieces look
    like a span of time; the best pair splits the row, of equal ones the earlier. Records may
    stand in brackets. Values come out without quoting, escaping and outer white space; a value
    that is missing is an empty string, and surplus pieces stay in the last value. A null, empty
    or blank field and a lone dash hold no record, nor do entries without any value, which
    aren't counted. Columns of `rows` named like a new one are replaced. Repeated rows come out repeatedly.
    """
    new = {position.lower(), *[v.lower() for v in values]}
    kept = [c for c in rows.columns if c != column and c.lower() not in new]
    most, wide = len(record_delimiters), len(values)
    every = "".join(record_delimiters)
    edge = "[\\s" + "".join(record_delimiters).replace("\n", "") + "]"
    held = rows.select(F.struct(*kept) if kept else F.lit(None), F.col(column)).toDF("_kept", "_field").where("_field is not null")
    held = computed_once(held, "_plain", stripped(masked(F.col("_field")))).drop("_field")
    held = held.where((F.length("_plain") > 0) & ~F.col("_plain").rlike("^[-‐-―−]+$"))
    held = computed_once(held, "_core", F.regexp_replace("_plain", f"^{edge}+|{edge}+$", "")).drop("_plain")
    core = F.col("_core")
    inner = F.substring(core, F.lit(2), F.greatest(F.length(core) - 2, F.lit(0)))
    boxed = F.regexp_replace(inner, rf"[)\]}}]\s*(?:{edge}\s*)*[(\[{{]", _CUT)
    held = computed_once(held, "_text", F.when(core.rlike(r"(?s)^[(\[{].*[)\]}]$"), boxed).otherwise(core)).drop("_core")
    text = F.col("_text")
    of_boxed = [(d, "") for d in value_delimiters]
    of_bare = [(d, b) for d in value_delimiters for b in [*record_delimiters, every, ""]]

    def listed(pairs: list[tuple[str, str]]) -> Column:
        return F.array(
            *[F.struct(F.lit(k).alias("k"), F.lit(d).alias("d"), F.lit(b).alias("b")) for k, (d, b) in enumerate(pairs)]
        )

    # a record delimiter counts only where the text has it, several together only where it has any
    possible = F.filter(
        F.when(text.contains(_CUT), listed(of_boxed)).otherwise(listed(of_bare)),
        lambda c: text.contains(c["d"]) & ((c["b"] == "") | (F.length(F.call_function("translate", text, c["b"], F.lit(""))) < F.length(text))),
    )
    scored = F.transform(possible, lambda c: _candidate(text, c, wide, most))
    # a field without any value delimiter holds values of the first kind only
    bare_values = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("order"), F.lit(value_delimiters[0]).alias("d"), F.lit(every).alias("b"))
    held = computed_once(held, "_best", F.coalesce(F.array_max(scored), bare_values))
    pattern = F.concat(F.lit("\\Q"), F.col("_best.d"), F.lit("\\E"))

    def tidy(pieces: Column) -> Column:
        last = F.array_join(F.slice(pieces, wide, F.greatest(F.size(pieces) - wide + 1, F.lit(1))), " ")
        of = [F.when(F.size(pieces) >= k + 1, pieces[k] if k < wide - 1 else last).otherwise("") for k in range(wide)]
        return F.struct(*[stripped(unmasked(v)).alias(name) for v, name in zip(of, values)])

    split = F.transform(_records(text, F.col("_best.b"), most), lambda r: tidy(F.split(r, pattern)))
    filled = F.filter(split, lambda r: reduce(lambda a, v: a | (F.length(r[v]) > 0), values, F.lit(False)))
    return held.select("_kept", F.posexplode(filled).alias("_at", "_record")).select(
        *[F.col("_kept")[c].alias(c) for c in kept],
        (F.col("_at") + 1).cast("long").alias(position),
        *[F.col("_record")[v].alias(v) for v in values],
    )
