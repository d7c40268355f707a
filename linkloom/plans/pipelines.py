"""Whole jobs composed of operators: guests out of protocols, merging of names by rounds, the map of interests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import similarity, text
from linkloom.operators import baskets, graph, mergesets

#: Headings of the block of guests in a protocol.
GUEST_HEADINGS = ("מוזמנים", ":מוזמנים", "מוזמנים:")


def guest_lines(protocols: DataFrame, meeting: str, header: str, block: str, headings: Sequence[str] = GUEST_HEADINGS) -> DataFrame:
    """(meeting_id, line): the lines that look like guests of the block under a heading, in files of one row per heading.

    Of several such blocks of a meeting the least is taken; a null block and a meeting without one have no lines.
    """
    blocks = protocols.where(F.col(header).isin(*headings)).groupBy(F.col(meeting).alias("meeting_id")).agg(F.min(block).alias("_b"))
    lines = blocks.select("meeting_id", F.explode(F.split("_b", "\n")).alias("line"))
    return lines.where(text.is_guest_row(F.col("line")))


def meeting_info(meetings: DataFrame) -> DataFrame:
    """(meeting_id, committee_id, meeting_title, session_content, meeting_date, reference_link, year), one row per id.

    Titles lose their commas; of several rows of an id the least is taken.
    """
    columns = [
        "committee_id", F.replace("title", F.lit(","), F.lit("")).alias("meeting_title"), "session_content", "meeting_date",
        F.col("reference").alias("reference_link"), text.year_of(F.col("meeting_date")).alias("year"),
    ]
    one = meetings.where("id is not null").groupBy(F.col("id").cast("string").alias("meeting_id")).agg(F.min(F.struct(*columns)).alias("_i"))
    return one.select("meeting_id", "_i.*")


def parsed_heads(heads: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(head, full_name, job_title, valid) of distinct heads of roster rows, a column head.

    lexicon: term and kind (first, last or title), of any size. The name begins with the first word that is a first name; later
    words belong to it if they are last names or hyphenated; the rest is the job title. A head is valid if it has a first
    name or a title. A head without words doesn't come out.
    """
    words = heads.select("head", F.posexplode(F.filter(F.split("head", r"(?U)\s+"), lambda w: F.length(w) > 0)).alias("at", "word"))
    kinds = lexicon.where("term is not null").groupBy(F.col("term").alias("word")).agg(F.collect_set("kind").alias("kinds"))  # at most three
    known = words.join(kinds, "word", "left").select("head", "at", "word", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
    is_ = lambda x, kind: F.array_contains(x["kinds"], kind)
    rows = known.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("at", "word", "kinds"))).alias("w"))  # the words of one line
    start = F.array_min(F.transform(F.filter("w", lambda x: is_(x, "first")), lambda x: x["at"]))
    rows = rows.withColumn("s", start)
    named = lambda x: F.col("s").isNotNull() & ((x["at"] == F.col("s")) | ((x["at"] > F.col("s")) & (is_(x, "last") | x["word"].contains("-"))))
    joined = lambda test: F.array_join(F.transform(F.filter("w", test), lambda x: x["word"]), " ")
    valid = F.col("s").isNotNull() | F.exists("w", lambda x: is_(x, "title"))
    return rows.select("head", joined(named).alias("full_name"), joined(lambda x: ~named(x)).alias("job_title"), valid.alias("valid"))


def parsed_guests(lines: DataFrame, line: str, lexicon: DataFrame, cleaning_terms: Sequence[str], lobby_terms: Sequence[str]) -> DataFrame:
    """text.guest_rows with a lexicon table in place of lists: the other columns, full_name, job_title, company and raw_company.

    Each distinct head is parsed once. Lines that are no guests, have one part or no valid name, or leave no work
    place, are dropped; other columns of those names are replaced.
    """
    kept = [c for c in lines.columns if c.lower() not in {line.lower(), "full_name", "job_title", "company", "raw_company"}]
    other = F.struct(*kept) if kept else F.lit(None)
    parts = lines.where(text.is_guest_row(F.col(line))).select(other.alias("_kept"), text.row_parts(F.col(line)).alias("_parts")).where(F.size("_parts") >= 2)
    split = parts.select("_kept", "_parts", F.get("_parts", F.lit(0)).alias("head"))
    heads = parsed_heads(split.select("head").distinct(), lexicon).where("valid")
    named = split.join(heads, "head").withColumn("_lobby", text.split_off_terms(F.element_at("_parts", -1), lobby_terms))
    middle = F.when(F.size("_parts") > 2, F.get("_parts", F.lit(1))).otherwise("")
    title = F.trim(F.regexp_replace(F.concat_ws(" ", "job_title", middle, "_lobby.found"), r"(?U)\s+", " "))
    raw = F.col("_lobby.rest")
    company = text.without_token_quotes(text.without_leading_terms(raw, cleaning_terms))
    found = named.select(*[F.col("_kept")[c].alias(c) for c in kept], "full_name", title.alias("job_title"), company.alias("company"), raw.alias("raw_company"))
    return found.where(F.length(F.trim("company")) > 0)


def extracted_guests(protocols: DataFrame, meeting: str, header: str, block: str, meetings: DataFrame, lexicon: DataFrame, cleaning_terms: Sequence[str], lobby_terms: Sequence[str]) -> DataFrame:
    """Guests of all protocols with their meetings' data; a meeting that is not listed has nulls."""
    lines = guest_lines(protocols, meeting, header, block)
    guests = parsed_guests(lines, "line", lexicon, cleaning_terms, lobby_terms)
    return guests.withColumn("meeting_id", F.col("meeting_id").cast("string")).join(meeting_info(meetings), "meeting_id", "left")


def candidate_scores(guests: DataFrame, person: str, company: str, iteration: int = 0, most: int = 5) -> DataFrame:
    """(c1, c2, ratio, fratio, pfratio, ptfratio, iou, intersection, union) of companies that share a person.

    From round 1 on only indicative persons, of at most `most` companies, link and count.
    """
    used = guests.select(person, company)
    if iteration:
        used = mergesets.indicative_persons(used, person, company, most).where("is_indicative_name")
    overlap = mergesets.set_overlap(used, person, company)
    scored = overlap.withColumn("_s", similarity.four_scores(F.col("c1"), F.col("c2")))
    return scored.select("c1", "c2", "_s.*", "iou", "intersection", "union")


def merge_round(guests: DataFrame, company: str, pairs: DataFrame) -> DataFrame:
    """guests with each company by the commonest name of its merge set; pairs has c1 and c2."""
    sets = mergesets.merge_sets(pairs, "c1", "c2")
    counts = guests.where(F.col(company).isNotNull()).groupBy(F.col(company).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return mergesets.renamed(guests, company, sets, mergesets.commonest_member(sets, counts))


def merged_by_rounds(guests: DataFrame, person: str, company: str, rounds: Sequence[Column]) -> DataFrame:
    """guests after one merge round per condition over candidate_scores, each on the names that the round before left."""
    for iteration, condition in enumerate(rounds):
        scores = candidate_scores(guests, person, company, iteration).where(condition)
        guests = merge_round(guests, company, scores.select("c1", "c2"))
    return guests


def interests_map(sources: Mapping[str, tuple[DataFrame, str, str, float]], metric: str, sectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one or several sources of baskets, each (rows, basket, item, least support); edges have a positive score.

    Scores are normalised per source, of several the greatest counts. nodes: item, sector, sector_num, log_count; the
    baskets of all sources count. edges: item_i, item_j, weight, types.
    """
    scored = [baskets.scored_pairs(rows, basket, item, metric, support) for rows, basket, item, support in sources.values()]
    pairs = baskets.merged_by_maximum(scored)
    relation = None
    for name, (rows, basket, item, _) in sources.items():
        one = baskets.basket_relation(rows, basket, item).select(F.concat_ws("\u0001", F.lit(name), F.col("basket").cast("string")).alias("basket"), "item")
        relation = one if relation is None else relation.unionByName(one)
    no_clusters = pairs.sparkSession.createDataFrame([], "item string, cluster int")
    return graph.node_table(relation, pairs, sectors, no_clusters).drop("cluster"), graph.edge_table(pairs, sectors)


def looked_up(names: DataFrame, name: str, country: str, pages: DataFrame) -> DataFrame:
    """names with category of their page: pages has title and category, several of each; without a page the category is null."""
    titled = names.withColumn("_title", text.looked_up_title(F.col(name), country))
    categories = pages.select(F.lower("title").alias("_title"), "category").distinct()
    return titled.join(categories, "_title", "left").drop("_title")


def official_names(names: DataFrame, name: str, found: DataFrame) -> DataFrame:
    """(name, official_name): of the results of a search (name, official_name, rank) the first of each name; names without one are left out."""
    first = found.where("official_name is not null").groupBy("name").agg(F.min_by("official_name", F.struct("rank", "official_name")).alias("official_name"))
    return names.select(F.col(name).alias("name")).distinct().join(first, "name")
