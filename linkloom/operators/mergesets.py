"""Pairs of names that denote one organisation: candidates, scores, merge sets and canonical names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.baskets import met_pairs
from linkloom.runtime import forget, written


def shared_person_pairs(guests: DataFrame, person: str, company: str) -> DataFrame:
    """(c1, c2): pairs c1 < c2 of companies that some person was listed with, distinct."""
    rows = guests.select(F.col(person).alias("p"), F.col(company).alias("c")).where("p is not null and c is not null").distinct()
    return met_pairs(rows, ["p"], "c").select(F.col("item_i").alias("c1"), F.col("item_j").alias("c2"))


def set_overlap(guests: DataFrame, person: str, company: str) -> DataFrame:
    """(c1, c2, iou, intersection, union) of the sets of persons of two companies that share one."""
    rows = guests.select(F.col(person).alias("p"), F.col(company).alias("c")).where("p is not null and c is not null").distinct()
    size = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    shared = met_pairs(rows, ["p"], "c").toDF("c1", "c2", "intersection")
    one = size.toDF("c1", "n1")
    two = size.toDF("c2", "n2")
    union = F.col("n1") + F.col("n2") - F.col("intersection")
    return shared.join(one, "c1").join(two, "c2").select(
        "c1", "c2", (F.col("intersection") / union).alias("iou"), "intersection", union.alias("union")
    )


def indicative_persons(guests: DataFrame, person: str, company: str, most: int = 5, lobbyists: DataFrame | None = None) -> DataFrame:
    """guests with count_companies_per_name and is_indicative_name: at most `most` companies, and no lobbyist."""
    counts = guests.groupBy(person).agg(F.count_distinct(company).alias("count_companies_per_name"))
    flagged = guests.join(counts.where(F.col(person).isNotNull()), person, "left")
    if lobbyists is not None:
        marked = lobbyists.toDF(person).distinct().withColumn("_lobbyist", F.lit(True))
        flagged = flagged.join(marked, person, "left")
    else:
        flagged = flagged.withColumn("_lobbyist", F.lit(None).cast("boolean"))
    few = F.coalesce(F.col("count_companies_per_name"), F.lit(0)) <= most
    return flagged.withColumn("is_indicative_name", few & F.col("_lobbyist").isNull()).drop("_lobbyist")


def without_rare(guests: DataFrame, company: str, meeting: str, least: int = 5) -> DataFrame:
    """guests of companies in at least `least` different meetings, with count_unique_meeting_ids."""
    counts = guests.groupBy(company).agg(F.count_distinct(meeting).alias("count_unique_meeting_ids"))
    return guests.join(counts.where(F.col("count_unique_meeting_ids") >= least), company)


#: Conditions under which a scored candidate pair is merged, by round.
CONDITIONS: dict[str, Callable[[], Column]] = {
    "ratio": lambda: F.col("fratio") >= 89,
    "overlap": lambda: ((F.col("iou") >= 0.1) & (F.col("intersection") >= 2))
    | ((F.col("iou") >= 0.05) & (F.col("intersection") >= 3)),
    "both": lambda: (F.col("iou") >= 0.01) & (F.col("fratio") >= 70),
    "filtered": lambda: F.col("fratio") >= 90,
}


def merge_sets(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(member, set_id): the connected components of pairs; set_id is the least member.

    Label propagation with pointer jumping: every round, members take the least label among their
    neighbours' and then that label's own label, so that long chains end in few rounds. Pairs
    with a null side and pairs of a name with itself link nothing and name no member.
    """
    sides = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = written(sides.unionByName(sides.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = written(edges.groupBy(F.col("x").alias("member")).agg(F.min("y").alias("m")).select("member", F.least("member", "m").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("member").alias("y"), "label"), "y").groupBy(F.col("x").alias("member")).agg(F.min("label").alias("near"))
        pulled = labels.join(near, "member").select("member", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        # members of one label follow the least that any of them has found
        hooked = pulled.groupBy(F.col("old")).agg(F.min("label").alias("to"))
        joined = pulled.join(hooked, "old").select("member", "old", F.least("label", "to").alias("label"))
        parent = joined.select(F.col("member").alias("label"), F.col("label").alias("above"))
        jumped = written(joined.join(parent, "label", "left").select("member", "old", F.least("label", "above").alias("label")))
        still = jumped.where("label <> old").isEmpty()
        forget(labels)
        labels = jumped.select("member", "label")
        labels._linkloom_path = getattr(jumped, "_linkloom_path", None)
        if still:
            return labels.select("member", F.col("label").alias("set_id"))


def commonest_member(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """(set_id, term): the member with the greatest count, ties to the least name; counts has name and n."""
    weighed = sets.join(counts.select(F.col("name").alias("member"), "n"), "member", "left")
    order = Window.partitionBy("set_id").orderBy(F.desc(F.coalesce("n", F.lit(0))), "member")
    return weighed.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("set_id", F.col("member").alias("term"))


def most_similar_member(sets: DataFrame, scores: DataFrame) -> DataFrame:
    """(set_id, term): the member with the greatest sum of similarities to the others; scores has a, b, score."""
    ends = F.explode(F.array("a", "b"))
    degree = scores.select(ends.alias("member"), "score").groupBy("member").agg(F.sum("score").alias("degree"))
    weighed = sets.join(degree, "member", "left")
    order = Window.partitionBy("set_id").orderBy(F.desc(F.coalesce("degree", F.lit(0.0))), "member")
    return weighed.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("set_id", F.col("member").alias("term"))


def renamed(rows: DataFrame, column: str, sets: DataFrame, terms: DataFrame) -> DataFrame:
    """rows with each name of the column replaced by the term of its merge set; other names stay."""
    to = sets.join(terms, "set_id").select(F.col("member").alias(column), F.col("term").alias("_term"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("_term", F.col(column))).drop("_term").select(rows.columns)


def rolled_up_counts(counts: DataFrame, sets: DataFrame, terms: DataFrame) -> DataFrame:
    """(name, n): counts summed under the canonical names."""
    return renamed(counts.select("name", "n"), "name", sets, terms).groupBy("name").agg(F.sum("n").alias("n"))


def rolled_up_pairs(pairs: DataFrame, sets: DataFrame, terms: DataFrame) -> DataFrame:
    """(item_i, item_j, n): pair counts summed under the canonical names; pairs within one set go."""
    both = renamed(renamed(pairs.select("item_i", "item_j", "n"), "item_i", sets, terms), "item_j", sets, terms)
    ordered = both.where("item_i <> item_j").select(F.least("item_i", "item_j").alias("item_i"), F.greatest("item_i", "item_j").alias("item_j"), "n")
    return ordered.groupBy("item_i", "item_j").agg(F.sum("n").alias("n"))


def pairs_of(sources: Sequence[DataFrame], columns: Sequence[str] = ("term1", "term2")) -> DataFrame:
    """The bag of all pairs of several sources."""
    whole = sources[0].select(*columns)
    for source in sources[1:]:
        whole = whole.unionByName(source.select(*columns))
    return whole


def pair_bag_difference(pairs: DataFrame, removed: DataFrame, a: str = "term1", b: str = "term2") -> DataFrame:
    """The bag of unordered pairs less one occurrence for each distinct removed pair, in either orientation.

    Removed rows are distinct by their exact text; double quotes around their terms are then taken away.
    """
    flat = lambda rows, one, two: rows.select(F.least(one, two).alias(a), F.greatest(one, two).alias(b))
    bare = removed.select(a, b).distinct().select(F.trim(F.regexp_replace(a, '^"+|"+$', "")).alias(a), F.trim(F.regexp_replace(b, '^"+|"+$', "")).alias(b))
    return flat(pairs, F.col(a), F.col(b)).exceptAll(flat(bare, F.col(a), F.col(b)))


def with_all_members(pairs: DataFrame, allowed: DataFrame) -> DataFrame:
    """The pairs whose two items are both in a one-column table."""
    names = allowed.toDF("item").distinct()
    left = pairs.join(names.withColumnRenamed("item", "item_i"), "item_i", "left_semi")
    return left.join(names.withColumnRenamed("item", "item_j"), "item_j", "left_semi").select(pairs.columns)


def organization_terms(sets: DataFrame, observed: DataFrame) -> DataFrame:
    """(organization, term): every observed name maps to itself, and every other member of its set maps to it."""
    names = observed.toDF("term").where("term is not null").distinct()
    of = sets.select(F.col("member").alias("term"), "set_id").join(names, "term", "left_semi")
    members = of.join(sets, "set_id").where("member <> term").select(F.col("member").alias("organization"), "term")
    return names.select(F.col("term").alias("organization"), "term").unionByName(members).distinct()


def same_value_pairs(rows: DataFrame, name: str, value: str) -> DataFrame:
    """(term1, term2): pairs of names with one value, as of terms that lead to one page."""
    one = rows.select(F.col(name).alias("term1"), F.col(value).alias("v")).where("term1 is not null and v is not null").distinct()
    return met_pairs(one.withColumnRenamed("term1", "c"), ["v"], "c").select(F.col("item_i").alias("term1"), F.col("item_j").alias("term2"))
