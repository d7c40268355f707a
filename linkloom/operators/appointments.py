"""Careers: prior employers matched to known organisations, and moves between bodies of mutual interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import similarity
from linkloom.functions.columns import computed_once


#: Buckets of characters by which pairs are dropped before their characters are compared.
BUCKETS = 16


def last_wins(rows: DataFrame, key: str, value: str, order: str = "row_no") -> DataFrame:
    """(key, value): of each non-null key the value of its last row in the order of a column; where it is missing or tied, the greatest value."""
    place = [order] if order in rows.columns else []
    last = F.max(F.struct(*place, value))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("_l")).select(key, F.col("_l")[value].alias(value))


def nearest_names(wanted: DataFrame, known: DataFrame, least_score: int = 85) -> DataFrame:
    """(prior_company, best_org_match, best_term_match, best_org_match_score) of names that match some known name.

    wanted has a column prior_company, known organization and term. Scores are matching-block ratios of distinct
    names; names meet at pieces that such a pair must share, and the bound by common characters drops
    pairs that can't reach the least score before any is computed. Ties go to the least organization.
    """
    # Matching blocks of M characters with u unmatched ones between them are at most u + 1, so one
    # has three characters if M > 2 (u + 1); shorter names meet at what deletions leave of both, of which
    # M characters are at least n share / (2 - share); for low scores at single characters.
    share = (least_score - 0.5) / 100
    short = 0.6 * 2 / (2.5 * share - 2) if share > 0.8 else float("inf")
    partner = short * (2 / share - 1)  # the longest name that a short one may match

    def remains(name: Column) -> Column:
        """The name and what up to three deletions leave of it, as far as that is long enough."""
        n = F.length(name)
        shorter = lambda texts: F.array_distinct(
            F.flatten(F.transform(texts, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda k: F.concat(F.substring(t, F.lit(1), k - 1), F.substring(t, k + 1, F.length(t))))))
        )
        level = whole = F.array(name)
        for gone in range(1, int(partner * (1 - share / (2 - share))) + 1):
            level = F.when(n - gone >= n * (share / (2 - share)) - 1e-9, shorter(level)).otherwise(F.array().cast("array<string>"))
            whole = F.concat(whole, level)
        return F.transform(whole, lambda t: F.concat(F.lit("="), t))

    def pieces(name: str) -> Column:
        n = F.length(name)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda k: F.substring(name, k, F.lit(3)))
        if share <= 0.8:
            return F.array_distinct(F.concat(runs, F.split(name, "")))
        return F.array_distinct(F.when(n <= partner, F.concat(runs, remains(F.col(name)))).otherwise(runs))

    def described(rows: DataFrame, name: str, mark: str) -> DataFrame:
        """Distinct names with their length and how many of their characters fall into each bucket."""
        distinct = rows.select(name).where(F.col(name).isNotNull()).distinct()
        bucket = F.transform(F.split(name, ""), lambda ch: F.pmod(F.crc32(ch.cast("binary")), F.lit(BUCKETS)))
        distinct = computed_once(distinct.select(name, F.length(name).alias(f"{mark}n")), "_b", bucket)
        counts = [F.size(F.filter("_b", F.lit(k).__eq__)).alias(f"{mark}{k}") for k in range(BUCKETS)]
        return distinct.select(name, f"{mark}n", *counts)

    left, right = described(wanted, "prior_company", "x"), described(known, "organization", "y")
    l_pieces = left.select("*", F.explode(pieces("prior_company")).alias("piece"))
    r_pieces = right.select("*", F.explode(pieces("organization")).alias("piece"))
    # characters in common, counted by bucket, bound the matching ones: twice these over both lengths
    common = sum((F.least(f"x{k}", f"y{k}") for k in range(1, BUCKETS)), F.least("x0", "y0"))
    enough = 200 * common >= (least_score - 0.5) * (F.col("xn") + F.col("yn"))
    met = l_pieces.join(r_pieces, "piece").where(enough).select("prior_company", "organization").distinct()
    l_characters = computed_once(left.select("prior_company"), "xs", similarity.numbered_characters(F.col("prior_company")))
    r_characters = computed_once(right.select("organization"), "ys", similarity.numbered_characters(F.col("organization")))
    close = met.join(l_characters, "prior_company").join(r_characters, "organization")
    close = close.where(similarity.may_reach(F.col("xs"), F.col("ys"), least_score))
    scored = close.withColumn("score", similarity.ratio(F.col("prior_company"), F.col("organization"))).where(F.col("score") >= least_score)
    best = scored.groupBy("prior_company").agg(F.min(F.struct((-F.col("score")).alias("s"), "organization")).alias("b"))
    named = best.select("prior_company", F.col("b.organization").alias("best_org_match"), (-F.col("b.s")).alias("best_org_match_score"))
    terms = last_wins(known, "organization", "term").toDF("best_org_match", "best_term_match")
    return named.join(terms, "best_org_match").select("prior_company", "best_org_match", "best_term_match", "best_org_match_score")


def revolving_doors(jobs: DataFrame, matches: DataFrame, types: DataFrame, strict: bool = False) -> DataFrame:
    """jobs whose prior company matches an organisation that is no company.

    types has org_name and type; an unknown type isn't company. With strict, the prior company itself
    has to be the matched organisation's name.
    """
    joined = jobs.where("prior_company is not null").join(matches, "prior_company")
    kind = types.select(F.col("org_name").alias("best_org_match"), "type").distinct()
    typed = joined.join(kind, "best_org_match", "left").where(~F.col("type").eqNullSafe(F.lit("company")))
    return typed.where(F.col("prior_company") == F.col("best_org_match")) if strict else typed


def shifts_with_interests(doors: DataFrame, rules: list[DataFrame], ids: DataFrame) -> DataFrame:
    """doors of people who went from a body to a company that has an interest in it.

    rules have antecedent (the company) and consequent (the body); ids has org_name and id; doors
    company id in the column id and the body in best_term_match.
    """
    whole = rules[0]
    for more in rules[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    named = whole.select(F.col("antecedent").alias("org_name"), F.col("consequent").alias("best_term_match"), "interest")
    with_id = named.join(ids.select("id", "org_name"), "org_name")
    return doors.join(with_id, ["id", "best_term_match"])
