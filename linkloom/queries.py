"""Named queries over a folder of tables, each (spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import html, similarity, text
from linkloom.operators import appointments, baskets, entities, graph, mergesets, packed, reconcile, rules
from linkloom.plans import pipelines
from linkloom.runtime import shared_folder
from linkloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        rows = rows.withColumn(c, F.round(c, 6))
    return rows


# --- packed fields ---------------------------------------------------------------------------


@query()
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    filed = table(spark, folder, "appointments").select("appointment_id", "prior_jobs")
    return packed.split_packed(filed, "prior_jobs", ["prior_role", "prior_company", "prior_duration"])


# --- baskets and pairs -----------------------------------------------------------------------


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as baskets of part names."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    names = table(spark, folder, "part").select("p_partkey", "p_name")
    return lines.join(names, "p_partkey").select("l_orderkey", "p_name")


def _bought(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as baskets of part names."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return _parts(spark, folder).join(orders, "l_orderkey").select("o_custkey", "p_name")


_RELATION = "rel AS (SELECT DISTINCT l_orderkey AS basket, p_name AS item FROM lineitem JOIN part ON p_partkey = l_partkey)"
_CUSTOMERS = (
    "rel AS (SELECT DISTINCT o_custkey AS basket, p_name AS item FROM lineitem JOIN part ON p_partkey = l_partkey"
    " JOIN orders ON o_orderkey = l_orderkey)"
)
_COUNTS = (
    "tot AS (SELECT count(DISTINCT basket) AS n FROM rel), cnt AS (SELECT item, count(*) AS c FROM rel GROUP BY item),"
    " ij AS (SELECT a.item AS item_i, b.item AS item_j, count(*) AS n_ij FROM rel a JOIN rel b ON a.basket = b.basket"
    " AND a.item < b.item GROUP BY 1, 2),"
    " sup AS (SELECT item_i, item_j, n_ij, x.c AS n_i, y.c AS n_j, n FROM ij JOIN cnt x ON x.item = item_i"
    " JOIN cnt y ON y.item = item_j CROSS JOIN tot)"
)
#: Least support of the pair queries.
SUPPORT = 0.0002


def _pairs_sql(score: str, relation: str = _RELATION, support: float = SUPPORT) -> str:
    return (
        f"WITH {relation}, {_COUNTS}, s AS (SELECT item_i, item_j, {score} AS score FROM sup WHERE n_ij >= n * {support})"
    )


_LIFT = "n_ij::DOUBLE * n / (n_i::DOUBLE * n_j)"
_JACCARD = "n_ij::DOUBLE / (n_i + n_j - n_ij)"


@query("SELECT basket, list_sort(list(DISTINCT item)) AS items, count(DISTINCT item)::BIGINT AS n FROM (SELECT l_orderkey AS basket, p_name AS item FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY basket")
def basket_sets(spark, folder):
    relation = baskets.basket_relation(_parts(spark, folder), "l_orderkey", "p_name")
    return baskets.item_sets(relation, "basket", "item").select(F.col("key").alias("basket"), F.col("values").alias("items"), "n")


@query(f"WITH {_RELATION} SELECT item, count(*)::BIGINT AS n_item, round(count(*)::DOUBLE / (SELECT count(DISTINCT basket) FROM rel), 6) AS support FROM rel GROUP BY item")
def item_support(spark, folder):
    return rounded(baskets.item_support(baskets.basket_relation(_parts(spark, folder), "l_orderkey", "p_name")), "support")


@query(f"WITH {_RELATION}, {_COUNTS} SELECT item_i, item_j, n_ij::BIGINT AS n_ij FROM ij WHERE n_ij >= 20")
def pair_support(spark, folder):
    return baskets.pair_counts(baskets.basket_relation(_parts(spark, folder), "l_orderkey", "p_name"), 20)


def _scored(spark, folder, metric, support=SUPPORT, excluded=None):
    return baskets.scored_pairs(_parts(spark, folder), "l_orderkey", "p_name", metric, support, excluded)


@query(_pairs_sql(f"ln({_LIFT})") + " SELECT item_i, item_j, round(score / (SELECT max(score) FROM s), 6) AS score FROM s")
def pair_pmi(spark, folder):
    return rounded(_scored(spark, folder, "pmi"), "score")


@query(_pairs_sql(f"ln({_LIFT} * (n_ij - floor(floor(n * {SUPPORT}) / 2)) / n_ij + floor(floor(n * {SUPPORT}) / 2) / n_ij)") + " SELECT item_i, item_j, round(score / (SELECT max(score) FROM s), 6) AS score FROM s")
def pair_weighted_pmi(spark, folder):
    return rounded(_scored(spark, folder, "weighted_pmi"), "score")


@query(_pairs_sql(_JACCARD) + " SELECT item_i, item_j, round(score / (SELECT max(score) FROM s), 6) AS score FROM s")
def pair_jaccard(spark, folder):
    return rounded(_scored(spark, folder, "jaccard"), "score")


@query(_pairs_sql(_JACCARD) + " SELECT item_i, item_j, round(sqrt(score / (SELECT max(score) FROM s)), 6) AS score FROM s")
def pair_root_jaccard(spark, folder):
    return rounded(_scored(spark, folder, "root_jaccard"), "score")


@query(_pairs_sql(f"ln({_LIFT})") + " SELECT item_i, item_j, round(score / max(score) OVER (), 6) AS score FROM s WHERE item_i NOT LIKE 'blue%' AND item_j NOT LIKE 'blue%'")
def pair_pmi_filtered(spark, folder):
    blue = table(spark, folder, "part").where(F.col("p_name").startswith("blue")).select("p_name").distinct()
    return rounded(_scored(spark, folder, "pmi", excluded=blue), "score")


@query(
    f"WITH a AS ({_pairs_sql(f'ln({_LIFT})')} SELECT item_i, item_j, score / max(score) OVER () AS score FROM s),"
    f" b AS ({_pairs_sql(f'ln({_LIFT})', _CUSTOMERS)} SELECT item_i, item_j, score / max(score) OVER () AS score FROM s)"
    " SELECT item_i, item_j, round(max(score), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE score > 0 GROUP BY 1, 2"
)
def pair_max_merge(spark, folder):
    orders = _scored(spark, folder, "pmi")
    customers = baskets.scored_pairs(_bought(spark, folder), "o_custkey", "p_name", "pmi", SUPPORT)
    return rounded(baskets.merged_by_maximum([orders, customers]), "score")


@query(_pairs_sql(_JACCARD) + ", m AS (SELECT floor(round(score, 9) / 0.01)::BIGINT AS bucket FROM s) SELECT bucket, round(bucket * 0.01::DOUBLE, 6) AS low, count(*)::BIGINT AS n FROM m GROUP BY bucket")
def score_histogram(spark, folder):
    pairs = baskets.frequent_pairs(baskets.basket_relation(_parts(spark, folder), "l_orderkey", "p_name"), "jaccard", SUPPORT)
    return rounded(baskets.score_histogram(pairs.withColumn("score", F.round("score", 9)), 0.01), "low")


# --- rules and rankings ----------------------------------------------------------------------


def _actions(spark, folder) -> DataFrame:
    """Users as baskets of the keys of their events."""
    events = table(spark, folder, "events").select("user_id", F.from_json("props", "k int")["k"].cast("string").alias("k"))
    return baskets.basket_relation(events, "user_id", "k")


_ACTIONS = "rel AS (SELECT DISTINCT user_id AS basket, json_extract_string(props, '$.k') AS item FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND user_id IS NOT NULL)"
_RULES = (
    f"WITH {_ACTIONS}, {_COUNTS}, d AS (SELECT item_i AS antecedent, item_j AS consequent, n_ij, n_i AS n_a, n_j AS n_c, n FROM sup"
    " UNION ALL SELECT item_j, item_i, n_ij, n_j, n_i, n FROM sup),"
    " r AS (SELECT antecedent, consequent, n_ij::DOUBLE / n_a AS confidence, n_ij::DOUBLE * n / (n_a::DOUBLE * n_c) AS lift,"
    " n_ij::DOUBLE / n_a - n_c::DOUBLE / n AS interest, n_a::DOUBLE / n AS antecedent_support, n_c::DOUBLE / n AS consequent_support FROM d)"
)
_FIVE = "round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(interest, 6) AS interest, round(antecedent_support, 6) AS antecedent_support, round(consequent_support, 6) AS consequent_support"
_BETWEEN = (
    ", o AS (SELECT r.*, row_number() OVER (PARTITION BY least(antecedent, consequent), greatest(antecedent, consequent) ORDER BY antecedent) AS k FROM r"
    " WHERE antecedent::INT % 3 <> 0 AND consequent::INT % 3 <> 1), f AS (SELECT * FROM o WHERE k = 1 AND interest >= 0.05)"
)


def _rounded_rules(rows):
    return rounded(rows, "confidence", "lift", "interest", "antecedent_support", "consequent_support")


def _between(spark, folder):
    relation = _actions(spark, folder)
    items = relation.select("item").distinct()
    third = F.col("item").cast("int") % 3
    return rules.rules_between(rules.association_rules(relation), items.where(third != 0), items.where(third != 1), 0.05)


@query(_RULES + f" SELECT antecedent, consequent, {_FIVE} FROM r")
def assoc_rules(spark, folder):
    return _rounded_rules(rules.association_rules(_actions(spark, folder)))


@query(_RULES + _BETWEEN + f" SELECT antecedent, consequent, {_FIVE} FROM f")
def rules_oriented_by_sector(spark, folder):
    return _rounded_rules(_between(spark, folder))


@query(
    _RULES + _BETWEEN + ", t AS (SELECT antecedent, consequent, row_number() OVER (PARTITION BY consequent ORDER BY interest DESC, antecedent) AS p FROM f)"
    " SELECT consequent AS government, coalesce(max(CASE WHEN p = 1 THEN antecedent END), '') AS \"top 1\","
    " coalesce(max(CASE WHEN p = 2 THEN antecedent END), '') AS \"top 2\", coalesce(max(CASE WHEN p = 3 THEN antecedent END), '') AS \"top 3\" FROM t GROUP BY 1"
)
def rules_top_k(spark, folder):
    return rules.top_per_consequent(_between(spark, folder), 3)


_PMI_AND_JACCARD = _pairs_sql(f"round(ln({_LIFT}), 9) AS pmi, round({_JACCARD}, 9)").replace("AS score FROM sup", "AS jaccard FROM sup")


def _two_rankings(spark, folder):
    relation = baskets.basket_relation(_parts(spark, folder), "l_orderkey", "p_name")
    fixed = lambda m: baskets.frequent_pairs(relation, m, SUPPORT).withColumn("score", F.round("score", 9))
    return fixed("pmi"), fixed("jaccard")


@query(
    _PMI_AND_JACCARD + ", k AS (SELECT item_i, item_j, row_number() OVER (ORDER BY pmi DESC, item_i, item_j) AS rank_1,"
    " row_number() OVER (ORDER BY jaccard DESC, item_i, item_j) AS rank_2 FROM s)"
    " SELECT item_i, item_j, rank_1::BIGINT AS rank_1, rank_2::BIGINT AS rank_2, (rank_1 - rank_2)::BIGINT AS difference FROM k"
)
def metric_rank_diff(spark, folder):
    return rules.rank_differences(*_two_rankings(spark, folder))


@query(
    _PMI_AND_JACCARD + ", k AS (SELECT item_i, item_j, row_number() OVER (ORDER BY pmi DESC, item_i, item_j) AS a,"
    " row_number() OVER (ORDER BY jaccard DESC, item_i, item_j) AS b FROM s) SELECT item_i, item_j FROM k WHERE a <= 50 AND b > 50"
)
def top_k_set_difference(spark, folder):
    return rules.only_in_first(*_two_rankings(spark, folder), 50)


@query(_PMI_AND_JACCARD + " SELECT item_i, item_j, pmi AS score FROM s ORDER BY pmi DESC, item_i, item_j LIMIT 1000")
def top_pairs(spark, folder):
    return rules.top_pairs(_two_rankings(spark, folder)[0].select("item_i", "item_j", "score"), 1000)


@query()
def sampled_rules(spark, folder):
    return rules.sample_of_top(_rounded_rules(rules.association_rules(_actions(spark, folder))), ["antecedent", "consequent"], "interest", 500, 30, 7)


# --- candidates and merge sets ---------------------------------------------------------------


@query("SELECT DISTINCT a.company AS c1, b.company AS c2 FROM guests a JOIN guests b ON a.full_name = b.full_name AND a.company < b.company")
def shared_person_pairs(spark, folder):
    return mergesets.shared_person_pairs(table(spark, folder, "guests"), "full_name", "company")


@query(
    "WITH rel AS (SELECT DISTINCT o_custkey AS p, p_name AS c FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey), n AS (SELECT c, count(*) AS n FROM rel GROUP BY c),"
    " x AS (SELECT a.c AS c1, b.c AS c2, count(*) AS i FROM rel a JOIN rel b ON a.p = b.p AND a.c < b.c GROUP BY 1, 2)"
    " SELECT c1, c2, round(i::DOUBLE / (u.n + v.n - i), 6) AS iou, i::BIGINT AS intersection, (u.n + v.n - i)::BIGINT AS \"union\""
    " FROM x JOIN n u ON u.c = c1 JOIN n v ON v.c = c2"
)
def company_overlap(spark, folder):
    return rounded(mergesets.set_overlap(_bought(spark, folder), "o_custkey", "p_name"), "iou")


@query(
    "WITH c AS (SELECT full_name, count(DISTINCT company) AS k FROM guests WHERE full_name IS NOT NULL GROUP BY 1)"
    " SELECT guest_id, guests.full_name, k::BIGINT AS count_companies_per_name, coalesce(k, 0) <= 5 AS is_indicative_name FROM guests LEFT JOIN c USING (full_name)"
)
def indicative_names(spark, folder):
    flagged = mergesets.indicative_persons(table(spark, folder, "guests").select("guest_id", "full_name", "company"), "full_name", "company")
    return flagged.select("guest_id", "full_name", "count_companies_per_name", "is_indicative_name")


@query(
    "WITH c AS (SELECT company, count(DISTINCT meeting_id) AS k FROM guests WHERE company IS NOT NULL GROUP BY 1 HAVING count(DISTINCT meeting_id) >= 5)"
    " SELECT guest_id, company, k::BIGINT AS count_unique_meeting_ids FROM guests JOIN c USING (company)"
)
def rare_filter(spark, folder):
    kept = mergesets.without_rare(table(spark, folder, "guests"), "company", "meeting_id", 5)
    return kept.select("guest_id", "company", "count_unique_meeting_ids")


@query(
    "WITH rel AS (SELECT DISTINCT o_custkey AS p, p_name AS c FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey), n AS (SELECT c, count(*) AS n FROM rel GROUP BY c),"
    " x AS (SELECT a.c AS c1, b.c AS c2, count(*) AS i FROM rel a JOIN rel b ON a.p = b.p AND a.c < b.c GROUP BY 1, 2)"
    " SELECT c1, c2 FROM x JOIN n u ON u.c = c1 JOIN n v ON v.c = c2 WHERE (i::DOUBLE / (u.n + v.n - i) >= 0.1 AND i >= 2) OR (i::DOUBLE / (u.n + v.n - i) >= 0.05 AND i >= 3)"
)
def candidate_conditions(spark, folder):
    scored = mergesets.set_overlap(_bought(spark, folder), "o_custkey", "p_name")
    return scored.where(mergesets.CONDITIONS["overlap"]()).select("c1", "c2")


def _nation_pairs(spark, folder) -> DataFrame:
    suppliers = table(spark, folder, "supplier").select("s_nationkey", "s_name")
    head = suppliers.groupBy("s_nationkey").agg(F.min("s_name").alias("head"))
    return suppliers.join(head, "s_nationkey").select(F.col("head").alias("term1"), F.col("s_name").alias("term2"))


@query("SELECT s_name AS member, min(s_name) OVER (PARTITION BY s_nationkey) AS set_id FROM supplier QUALIFY count(*) OVER (PARTITION BY s_nationkey) > 1")
def merge_components(spark, folder):
    return mergesets.merge_sets(_nation_pairs(spark, folder), "term1", "term2")


_CANONICAL = (
    "WITH c AS (SELECT s_name, s_nationkey, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2),"
    " t AS (SELECT s_nationkey, min(s_name) OVER w AS set_id, s_name, n, row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, s_name) AS k,"
    " count(*) OVER (PARTITION BY s_nationkey) AS m, first_value(s_name) OVER (PARTITION BY s_nationkey ORDER BY n DESC, s_name) AS term FROM (SELECT s_name, s_nationkey, coalesce(n, 0) AS n FROM supplier LEFT JOIN c USING (s_name, s_nationkey)) WINDOW w AS (PARTITION BY s_nationkey))"
)


def _supplier_counts(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, folder, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_name").alias("name"), "n")


@query(_CANONICAL + " SELECT set_id, term FROM t WHERE k = 1 AND m > 1")
def canonical_term(spark, folder):
    sets = mergesets.merge_sets(_nation_pairs(spark, folder), "term1", "term2")
    return mergesets.commonest_member(sets, _supplier_counts(spark, folder))


@query(_CANONICAL + " SELECT term AS name, sum(n)::BIGINT AS n FROM t WHERE n > 0 GROUP BY 1")
def count_rollup(spark, folder):
    counts = _supplier_counts(spark, folder)
    sets = mergesets.merge_sets(_nation_pairs(spark, folder), "term1", "term2")
    return mergesets.rolled_up_counts(counts, sets, mergesets.commonest_member(sets, counts))


@query(
    "WITH p AS (SELECT least(term1, term2) AS term1, greatest(term1, term2) AS term2, count(*) AS n FROM merge_pairs WHERE origin = 'fuzzy' GROUP BY 1, 2),"
    " r AS (SELECT least(term1, term2) AS term1, greatest(term1, term2) AS term2, count(*) AS m FROM (SELECT DISTINCT term1, term2 FROM merge_pairs WHERE origin = 'manual') GROUP BY 1, 2)"
    " SELECT p.term1, p.term2 FROM p LEFT JOIN r ON p.term1 IS NOT DISTINCT FROM r.term1 AND p.term2 IS NOT DISTINCT FROM r.term2, unnest(range(greatest(n - coalesce(m, 0), 0)))"
)
def pair_bag_difference(spark, folder):
    pairs = table(spark, folder, "merge_pairs")
    return mergesets.pair_bag_difference(pairs.where("origin = 'fuzzy'"), pairs.where("origin = 'manual'"))


@query("SELECT term1, term2 FROM merge_pairs WHERE origin = 'fuzzy' UNION ALL SELECT term1, term2 FROM merge_pairs WHERE origin = 'manual'")
def pair_bag_union(spark, folder):
    pairs = table(spark, folder, "merge_pairs")
    return mergesets.pairs_of([pairs.where("origin = 'fuzzy'"), pairs.where("origin = 'manual'")])


@query(
    "WITH m AS (SELECT s_name, s_nationkey FROM supplier), o AS (SELECT DISTINCT s_name AS term, s_nationkey FROM supplier WHERE s_acctbal > 0)"
    " SELECT term AS organization, term FROM o UNION SELECT m.s_name, o.term FROM o JOIN m USING (s_nationkey) WHERE m.s_name <> o.term"
)
def organization_terms(spark, folder):
    sets = mergesets.merge_sets(_nation_pairs(spark, folder), "term1", "term2")
    observed = table(spark, folder, "supplier").where("s_acctbal > 0").select("s_name")
    return mergesets.organization_terms(sets, observed)


@query(
    f"WITH {_RELATION}, {_COUNTS}, ok AS (SELECT DISTINCT p_name FROM part WHERE p_name LIKE '%gear' OR p_name LIKE '%bolt')"
    " SELECT item_i, item_j, n_ij::BIGINT AS n_ij FROM ij WHERE item_i IN (FROM ok) AND item_j IN (FROM ok)"
)
def pairs_of_allowed(spark, folder):
    pairs = baskets.pair_counts(baskets.basket_relation(_parts(spark, folder), "l_orderkey", "p_name"))
    allowed = table(spark, folder, "part").where(F.col("p_name").rlike("(gear|bolt)$")).select("p_name")
    return mergesets.with_all_members(pairs, allowed)


@query("SELECT DISTINCT a.c_name AS term1, b.c_name AS term2 FROM customer a JOIN customer b ON a.c_acctbal = b.c_acctbal AND a.c_name < b.c_name")
def same_value_pairs(spark, folder):
    return mergesets.same_value_pairs(table(spark, folder, "customer"), "c_name", "c_acctbal")


# --- strings, dates, packed triples ----------------------------------------------------------


#: White space and its opposite in SQL patterns.
_S, _NS = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]", "[^\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


@query(
    f"WITH r AS (SELECT doc_id, regexp_replace(text, '^((The|A|Mr|Mrs|Prof){_NS}*{_S}+)+', '') AS rest FROM documents)"
    f" SELECT doc_id, CASE WHEN regexp_matches(rest, '^(The|A|Mr|Mrs|Prof){_NS}*$') THEN '' ELSE rest END AS rest FROM r"
)
def clean_prefix_words(spark, folder):
    """All texts: '' if nothing is left, null for null."""
    rest = text.without_leading_terms(F.col("text"), ["The", "A", "Mr", "Mrs", "Prof"])
    return table(spark, folder, "documents").select("doc_id", rest.alias("rest"))


@query("SELECT p_partkey, split_part(p_name, ' ', -1) AS last_word, split_part(p_name, ' ', 1) AS first_word, upper(p_name) AS upper_name, reverse(p_name) AS reversed FROM part")
def split_tokens(spark, folder):
    part = table(spark, folder, "part")
    first = F.substring_index("p_name", " ", 1)
    return part.select("p_partkey", text.last_segment(F.col("p_name"), " ").alias("last_word"), first.alias("first_word"), F.upper("p_name").alias("upper_name"), F.reverse("p_name").alias("reversed"))


@query("SELECT guest_id, split_part(reference_link, '/', -1) AS last_segment, right(meeting_date, 4) AS year FROM guests")
def url_last_segment(spark, folder):
    guests = table(spark, folder, "guests")
    return guests.select("guest_id", text.last_segment(F.col("reference_link"), "/").alias("last_segment"), text.year_of(F.col("meeting_date")).alias("year"))


@query("SELECT doc_id, ((length(text) - length(replace(text, 'the ', ''))) / 4)::BIGINT AS the_count, ((length(text) - length(replace(text, 'של', ''))) / 2)::BIGINT AS shel_count FROM documents WHERE text IS NOT NULL")
def substring_counts(spark, folder):
    documents = table(spark, folder, "documents").where("text is not null")
    return documents.select(
        "doc_id", text.substring_count(F.col("text"), F.lit("the ")).alias("the_count"), text.substring_count(F.col("text"), F.lit("של")).alias("shel_count")
    )


@query("SELECT doc_id, regexp_matches(text, '[\\x{0590}-\\x{05FF}]') AS hebrew FROM documents WHERE text IS NOT NULL")
def script_test(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", text.has_hebrew(F.col("text")).alias("hebrew"))


@query("WITH d AS (SELECT max(o_orderdate)::DATE AS hi, min(o_orderdate)::DATE AS lo FROM orders) SELECT strftime(x, '%Y%m%d') AS day FROM d, unnest(generate_series(hi, lo, INTERVAL '-7' DAY)) AS t(x)")
def date_sequence(spark, folder):
    ends = table(spark, folder, "orders").agg(F.max("o_orderdate").cast("date").cast("string"), F.min("o_orderdate").cast("date").cast("string")).collect()[0]
    return text.days_down(spark, ends[0], ends[1], 7)


@query(
    "WITH j AS (SELECT o_custkey, string_agg('(' || o_orderpriority || '##' || o_orderkey::VARCHAR || '##' || o_orderstatus || ')', ',' ORDER BY o_orderkey) AS s FROM orders GROUP BY 1),"
    " e AS (SELECT o_custkey, unnest(string_split(s, ',')) AS x FROM j)"
    " SELECT o_custkey, split_part(trim(x, '()'), '##', 1) AS role, split_part(trim(x, '()'), '##', 2) AS company, split_part(trim(x, '()'), '##', 3) AS duration FROM e"
)
def explode_prior_jobs(spark, folder):
    orders = table(spark, folder, "orders")
    entry = F.format_string("(%s##%s##%s)", "o_orderpriority", F.col("o_orderkey").cast("string"), "o_orderstatus")
    lists = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e")))).alias("l"))
    filed = lists.select("o_custkey", F.array_join(F.col("l.e"), ",").alias("jobs"))
    jobs = text.exploded(filed.select("o_custkey", text.triples(F.col("jobs")).alias("t")), "t", "job")
    return jobs.select("o_custkey", "job.role", "job.company", "job.duration")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '[a-z] [a-z]') AND p_name IS NOT NULL")
def two_word_filter(spark, folder):
    return table(spark, folder, "part").where(F.col("p_name").rlike(r"(?U)\w\s\w")).select("p_partkey", "p_name")


@query(f"SELECT guest_id FROM guests WHERE job_title IS NOT NULL AND (regexp_matches(job_title, '{_S}[-–]{_S}') OR len(string_split(job_title, ',')) > 2) AND trim(job_title) <> '' AND NOT contains(job_title, ':')")
def guest_row_pattern(spark, folder):
    return table(spark, folder, "guests").where(text.is_guest_row(F.col("job_title"))).select("guest_id")


def _name_lexicon(spark, folder) -> DataFrame:
    """The formal names and short forms as first names, the last word of each guest's name as a last name, and titles."""
    names = table(spark, folder, "nicknames").select(F.explode(F.array("formal", "short_form")).alias("term"), F.lit("first").alias("kind"))
    last = table(spark, folder, "guests").select(text.last_segment(F.col("full_name"), " ").alias("term"), F.lit("last").alias("kind"))
    titles = spark.createDataFrame([("Dr.", "title"), ("Prof.", "title")], "term string, kind string")
    return names.unionByName(last).unionByName(titles).where("term <> ''").distinct()


def _guest_line() -> Column:
    return F.concat_ws(" - ", "full_name", "job_title", "company")


@query()
def guest_rows(spark, folder):
    lines = table(spark, folder, "guests").select("guest_id", _guest_line().alias("line"))
    return pipelines.parsed_guests(lines, "line", _name_lexicon(spark, folder), ["משרד"], ["לוביסט"])


def _protocols(spark, folder) -> DataFrame:
    """Protocols with one row per heading: the guests of each meeting, and a closing."""
    guests = table(spark, folder, "guests").where("meeting_id is not null").select("meeting_id", F.struct("guest_id", _guest_line().alias("line")).alias("g"))
    blocks = guests.groupBy("meeting_id").agg(F.array_join(F.array_sort(F.collect_list("g"))["line"], "\n").alias("block"))
    heads = F.array(F.struct(F.when(F.col("meeting_id").endswith("1"), ":מוזמנים").otherwise("מוזמנים:").alias("header"), F.col("block")), F.struct(F.lit("סיום").alias("header"), F.lit("a - b, c").alias("block")))
    return blocks.select("meeting_id", F.explode(heads).alias("h")).select("meeting_id", "h.header", "h.block")


_DASHED = f"regexp_matches(line, '{_S}[-–]{_S}') OR len(string_split(line, ',')) > 2"


@query(
    f"WITH b AS (SELECT meeting_id, string_agg(concat_ws(' - ', full_name, job_title, company), chr(10) ORDER BY guest_id) AS block FROM guests WHERE meeting_id IS NOT NULL GROUP BY 1),"
    " l AS (SELECT meeting_id, unnest(string_split(block, chr(10))) AS line FROM b)"
    " SELECT l.meeting_id, line, committee_id, replace(title, ',', '') AS meeting_title, right(meeting_date, 4) AS year FROM l LEFT JOIN committee_meetings m ON m.id::VARCHAR = l.meeting_id"
    f" WHERE ({_DASHED}) AND trim(line) <> '' AND NOT contains(line, ':')"
)
def meeting_guest_lines(spark, folder):
    lines = pipelines.guest_lines(_protocols(spark, folder), "meeting_id", "header", "block")
    info = pipelines.meeting_info(table(spark, folder, "committee_meetings"))
    return lines.join(info, "meeting_id", "left").select("meeting_id", "line", "committee_id", "meeting_title", "year")


@query()
def extracted_guests(spark, folder):
    """Guests of all protocols with their meetings."""
    return pipelines.extracted_guests(_protocols(spark, folder), "meeting_id", "header", "block", table(spark, folder, "committee_meetings"), _name_lexicon(spark, folder), ["משרד"], ["לוביסט"])


@query("SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE kind = 'protocol') WHERE line LIKE '% - %' AND NOT contains(line, ':') AND trim(line) <> ''")
def protocol_rows(spark, folder):
    protocols = table(spark, folder, "documents").where("kind = 'protocol'")
    lines = protocols.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.col("line").contains(" - ") & text.is_guest_row(F.col("line"))).select("doc_id", "line")


# --- sources reconciled ----------------------------------------------------------------------


@query(
    "SELECT c_custkey, coalesce(a.p, b.p) AS o_orderpriority, a.p IS NOT NULL AS exists_online FROM customer"
    " LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON a.o_custkey = c_custkey"
    " LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON b.o_custkey = c_custkey"
)
def left_join_coalesce(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, folder, "customer").select("c_custkey")
    return reconcile.with_fallback(customers, "c_custkey", orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), ["o_orderpriority"])


@query(
    "WITH a AS (SELECT DISTINCT c_custkey AS v FROM customer), b AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_orderstatus = 'P')"
    " SELECT (SELECT count(*) FROM a FULL JOIN b USING (v) WHERE a.v IS NULL OR b.v IS NULL) = 0 AS equal, (SELECT count(*) FROM a)::BIGINT AS n_a, (SELECT count(*) FROM b)::BIGINT AS n_b,"
    " (SELECT count(*) FROM a WHERE v NOT IN (FROM b))::BIGINT AS only_a, (SELECT count(*) FROM b WHERE v NOT IN (FROM a))::BIGINT AS only_b,"
    " (SELECT count(*) FROM (FROM a UNION FROM b))::BIGINT AS n_union,"
    " ((SELECT count(*) FROM a WHERE v NOT IN (FROM b)) + (SELECT count(*) FROM b WHERE v NOT IN (FROM a)))::BIGINT AS n_symmetric"
)
def id_reconciliation(spark, folder):
    a = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    b = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return reconcile.set_comparison(a, b, "id")


_WORDS = "list_distinct(list_filter(regexp_split_to_array({c}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> ''))"


@query(
    f"WITH x AS (SELECT organization AS s, count(*) AS many FROM article_baskets WHERE organization IS NOT NULL GROUP BY 1), w AS (SELECT s, many, {_WORDS.format(c='s')} AS l FROM x),"
    " c AS (SELECT t.s AS term, sum((length(o.s) - length(replace(o.s, t.s, ''))) // length(t.s) * o.many) AS k FROM w t JOIN w o ON list_has_all(o.l, t.l) WHERE len(t.l) > 0 GROUP BY 1)"
    " SELECT x.s AS term, many::BIGINT AS positive_count, coalesce(k, 0)::BIGINT AS total_count, round(many::DOUBLE / nullif(coalesce(k, 0), 0), 6) AS discovery_ratio FROM x LEFT JOIN c ON c.term = x.s"
)
def discovery_ratio(spark, folder):
    """All spellings in all rows."""
    mentions = table(spark, folder, "article_baskets").where("organization is not null")
    terms = mentions.groupBy(F.col("organization").alias("term")).agg(F.count(F.lit(1)).alias("positive_count"))
    return rounded(reconcile.discovery_ratio(mentions, "organization", terms), "discovery_ratio")


_PADDED = "' ' || trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')) || ' '"


@query(
    f"WITH n AS (SELECT DISTINCT name AS organization, {_PADDED.format(c='name')} AS p FROM entity_database WHERE name IS NOT NULL), d AS (SELECT doc_id AS article, {_PADDED.format(c='text')} AS body FROM documents WHERE text IS NOT NULL)"
    " SELECT DISTINCT organization, article FROM n JOIN d ON contains(body, p) WHERE trim(p) <> ''"
)
def gazetteer_mentions(spark, folder):
    """All names in all texts."""
    names = table(spark, folder, "entity_database").select("name")
    return reconcile.gazetteer_mentions(table(spark, folder, "documents"), "doc_id", "text", names)


@query("SELECT type AS category, count(*)::BIGINT AS n FROM entity_database GROUP BY 1")
def category_counts(spark, folder):
    return reconcile.category_counts(table(spark, folder, "entity_database").select(F.array("type").alias("t")), "t")


@query("SELECT sub_type, 'matches' AS dataset, count(*)::BIGINT AS n FROM org_entity_matches WHERE sub_type IS NOT NULL AND sub_type <> 'other' GROUP BY 1")
def types_histogram(spark, folder):
    return entities.types_histogram(table(spark, folder, "org_entity_matches"), "matches")


# --- the register of entities ----------------------------------------------------------------


@query(
    "WITH u AS (SELECT c_nationkey::BIGINT AS id, c_name AS name, 0 AS r FROM customer UNION ALL SELECT s_nationkey, s_name, 1 FROM supplier UNION ALL SELECT p_partkey, p_name, 2 FROM part)"
    " SELECT id, name FROM (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY r, name) AS k FROM u) WHERE k = 1"
)
def first_wins_dedup(spark, folder):
    sources = [("customer", "c_nationkey", "c_name"), ("supplier", "s_nationkey", "s_name"), ("part", "p_partkey", "p_name")]
    whole = None
    for rank, (name, key, label) in enumerate(sources):
        rows = table(spark, folder, name).select(F.col(key).cast("long").alias("id"), F.col(label).alias("name"), F.lit(rank).alias("r"))
        whole = rows if whole is None else whole.unionByName(rows)
    return entities.first_by_key(whole, "id", ["r", "name"]).select("id", "name")


@query("SELECT id, type, name, coalesce(name_eng, '') AS name_eng FROM entity_database")
def entity_register(spark, folder):
    listed = table(spark, folder, "entity_database")
    one = listed.withColumnRenamed("type", "kind").withColumnRenamed("name_eng", "name_en")
    two = listed.select(F.col("id").alias("Association_Number"), F.col("name").alias("Association_Name"))
    return entities.entity_database([entities.registry(one, 0), entities.registry(two, 1, "association")])


@query(
    "SELECT n_nationkey, r_name AS parent, n_name AS child FROM nation JOIN region ON r_regionkey = n_regionkey"
)
def hierarchy_split(spark, folder):
    nation = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = nation.select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("name"))
    return text.hierarchy(joined, "name").select("n_nationkey", "parent", "child")


@query("SELECT n_nationkey, min(n_name) OVER (PARTITION BY n_regionkey) AS spelling FROM nation")
def first_spelling(spark, folder):
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_regionkey").alias("key"), F.col("n_name").alias("spelling"))
    return entities.first_spelling(nation, "key", "spelling", "spelling").select("n_nationkey", "spelling")


@query(
    f"WITH m AS (SELECT DISTINCT org_name, {_PADDED.format(c='org_name')} AS p FROM org_entity_matches WHERE org_name IS NOT NULL), e AS (SELECT id, {_PADDED.format(c='name')} AS n FROM entity_database WHERE name IS NOT NULL"
    f" UNION SELECT id, {_PADDED.format(c='name_eng')} FROM entity_database WHERE name_eng IS NOT NULL) SELECT DISTINCT org_name, id FROM m JOIN e ON contains(n, p) WHERE trim(p) <> ''"
)
def containing_entities(spark, folder):
    """All typed names."""
    typed = table(spark, folder, "org_entity_matches")
    return entities.containing_entities(typed, table(spark, folder, "entity_database")).select("org_name", "id").distinct()


#: Types of the register's sub-types.
TYPES = {
    "municipality": "government", "local_council": "government", "ministry": "government", "statutory_authority": "government",
    "municipal": "government", "government": "government", "private_company": "company", "public_company": "company",
    "foreign_company": "company", "nonprofit_association": "company", "water_corporation": "company", "higher_education": "company",
}


@query()
def entity_link(spark, folder):
    typed = table(spark, folder, "org_entity_matches")
    return entities.link_entities(typed, table(spark, folder, "entity_database"), text.mapped_type(F.col("sub_type"), TYPES))


@query(
    "SELECT id, CASE WHEN type IN ('municipality','local_council','ministry','statutory_authority','municipal','government') THEN 'government'"
    " WHEN type IN ('private_company','public_company','foreign_company','nonprofit_association','water_corporation','higher_education') THEN 'company' ELSE 'other' END AS mapped FROM entity_database"
)
def mapped_types(spark, folder):
    return table(spark, folder, "entity_database").select("id", text.mapped_type(F.col("type"), TYPES).alias("mapped"))


# --- similarity and careers ------------------------------------------------------------------


def _part_pairs(spark, folder, least) -> DataFrame:
    """All pairs of part names that may have a ratio of at least `least`: all that share a letter and pass the bound of common characters."""
    names = table(spark, folder, "part").select(F.col("p_name").alias("a")).where("a <> ''").distinct()
    characters = names.withColumn("ca", similarity.numbered_characters(F.col("a")))
    sized = characters.withColumn("n", F.size("ca"))
    # M matching characters of n + m are at least the share, so that they are in all but n - M of the rarest of each
    often = sized.select(F.explode("ca").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("often"))
    ranked = sized.select("a", "n", F.explode("ca").alias("c")).join(often, "c").groupBy("a", "n").agg(F.array_sort(F.collect_list(F.struct("often", "c"))).alias("s"))
    # the other text has at least n t / (2 - t) characters, t the share, so that M is at least n t / (2 - t)
    share = (least - 0.5) / 100
    prefix = F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * F.lit(share / (2 - share)) - 1e-9) + 1).cast("int"))
    first = ranked.select("a", F.explode(prefix).alias("p")).select("a", "p.c")
    met = first.join(first.toDF("b", "c"), "c").where("a < b").select("a", "b").distinct()
    return met.join(characters, "a").join(characters.toDF("b", "cb"), "b").where(similarity.may_reach(F.col("ca"), F.col("cb"), least))


@query()
def fuzzy_ratio(spark, folder):
    pairs = _part_pairs(spark, folder, 60)
    return pairs.select("a", "b", similarity.ratio(F.col("a"), F.col("b")).alias("fratio")).where("fratio >= 60")


@query()
def fuzzy_token_sort(spark, folder):
    pairs = _part_pairs(spark, folder, 50)
    return pairs.select("a", "b", similarity.token_sort(F.col("a"), F.col("b")).alias("score"))


@query()
def fuzzy_four_scores(spark, folder):
    pairs = _part_pairs(spark, folder, 50)
    return pairs.select("a", "b", similarity.four_scores(F.col("a"), F.col("b")).alias("s")).select("a", "b", "s.*")


def _career_jobs(spark, folder) -> DataFrame:
    return p2_found(spark, folder).where("prior_company <> ''")


@query()
def nearest_name(spark, folder):
    names = table(spark, folder, "entity_database").where("name is not null").select(F.col("name").alias("organization"), F.col("name").alias("term"))
    return appointments.nearest_names(_career_jobs(spark, folder), names, 85)


@query()
def revolving_doors(spark, folder):
    register = table(spark, folder, "entity_database")
    matches = nearest_name(spark, folder)
    kinds = register.select(F.col("name").alias("org_name"), text.mapped_type(F.col("type"), TYPES).alias("type"))
    return appointments.revolving_doors(_career_jobs(spark, folder), matches, kinds)


@query(
    "SELECT a.id, a.best_term_match, c_name AS org_name, round(c_acctbal, 6) AS interest FROM"
    " (SELECT DISTINCT o_custkey AS id, o_orderpriority AS best_term_match FROM orders) a JOIN customer ON c_custkey = a.id WHERE a.best_term_match = '1-URGENT'"
)
def occupational_shifts(spark, folder):
    doors = table(spark, folder, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("best_term_match")).distinct()
    customers = table(spark, folder, "customer")
    rule = customers.select(F.col("c_name").alias("antecedent"), F.lit("1-URGENT").alias("consequent"), F.col("c_acctbal").alias("interest"))
    ids = customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("org_name"))
    return rounded(appointments.shifts_with_interests(doors, [rule], ids).select("id", "best_term_match", "org_name", "interest"), "interest")


# --- graphs ----------------------------------------------------------------------------------


def _sectors(spark, folder) -> DataFrame:
    last = text.last_segment(F.col("p_name"), " ")
    sector = F.when(last.isin("gear", "bolt"), "government").when(last.isin("ring", "rod", "plate"), "company").otherwise("other")
    return table(spark, folder, "part").select(F.col("p_name").alias("item"), sector.alias("sector")).distinct()


def _positive(spark, folder) -> DataFrame:
    return _scored(spark, folder, "pmi").where("score > 0")


@query()
def edge_betweenness(spark, folder):
    return graph.bottlenecks(table(spark, folder, "merge_pairs"), "term1", "term2")


@query()
def spectral_clusters(spark, folder):
    return graph.spectral_clusters(_positive(spark, folder), 8)


@query()
def co_clusters(spark, folder):
    return graph.co_clusters(_positive(spark, folder), _sectors(spark, folder), 4)


@query()
def kmeans_labels(spark, folder):
    return rounded(graph.k_means(table(spark, folder, "embeddings"), "vec_id", "embedding", 10), "distance")


@query()
def graph_nodes(spark, folder):
    relation = baskets.basket_relation(_parts(spark, folder), "l_orderkey", "p_name")
    pairs = _positive(spark, folder)
    return rounded(graph.node_table(relation, pairs, _sectors(spark, folder), graph.spectral_clusters(pairs, 8)), "log_count")


_SECTOR = "CASE WHEN split_part(p_name, ' ', -1) IN ('gear', 'bolt') THEN 'government' WHEN split_part(p_name, ' ', -1) IN ('ring', 'rod', 'plate') THEN 'company' ELSE 'other' END"


@query(
    _pairs_sql(f"ln({_LIFT})") + f", c AS (SELECT DISTINCT p_name AS item, {_SECTOR} AS sector FROM part)"
    " SELECT item_i, item_j, round(score / (SELECT max(score) FROM s), 6) AS weight, CASE WHEN (x.sector = 'government' AND y.sector = 'company') OR (x.sector = 'company' AND y.sector = 'government') THEN 1.0 ELSE 0.4 END::DOUBLE AS types"
    " FROM s JOIN c x ON x.item = item_i JOIN c y ON y.item = item_j WHERE score > 0"
)
def graph_edges(spark, folder):
    return rounded(graph.edge_table(_positive(spark, folder), _sectors(spark, folder)), "weight")


@query(
    _pairs_sql(f"ln({_LIFT})") + f", c AS (SELECT DISTINCT p_name AS item, {_SECTOR} AS sector FROM part)"
    " SELECT item_i, item_j, x.sector AS cluster FROM s JOIN c x ON x.item = item_i JOIN c y ON y.item = item_j WHERE score > 0 AND x.sector = y.sector"
)
def cluster_subgraph(spark, folder):
    return graph.within_clusters(_positive(spark, folder), _sectors(spark, folder)).select("item_i", "item_j", "cluster")


# --- pages -----------------------------------------------------------------------------------


def _escaped(text_: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text_ = F.replace(text_, F.lit(mark), F.lit(entity))
    return text_


def _all_pages(spark, folder) -> DataFrame:
    """References of all guests as pages; a null title is empty, without a reference there is no target."""
    target = F.coalesce(F.concat(F.lit(' href="'), _escaped(F.col("reference_link")), F.lit('"')), F.lit(""))
    title = _escaped(F.coalesce("job_title", F.lit("")))
    page = F.concat(F.lit("<html><head><title>x</title></head><body><!-- c --><p>"), title, F.lit("</p><script>y</script><a"), target, F.lit(">z</a></body></html>"))
    return table(spark, folder, "guests").select("guest_id", page.alias("html"))


@query(
    f"SELECT guest_id, trim(regexp_replace(coalesce(job_title, ''), '^{_S}+|{_S}+$', '', 'g') || ' z') AS shown FROM guests"
)
def html_visible_text(spark, folder):
    return _all_pages(spark, folder).select("guest_id", html.visible_text(F.col("html")).alias("shown"))


@query("SELECT guest_id, reference_link AS link FROM guests WHERE contains(reference_link, 'http')")
def html_links(spark, folder):
    return _all_pages(spark, folder).select("guest_id", F.explode(html.matching_links(F.col("html"), "http")).alias("link"))


# --- merging by rounds, the map of interests ---------------------------------------------------

_SHARED = (
    "u AS (SELECT DISTINCT full_name AS p, company AS c FROM {rows} WHERE full_name IS NOT NULL AND company IS NOT NULL), z AS (SELECT c, count(*) AS n FROM u GROUP BY 1),"
    " o AS (SELECT a.c AS c1, b.c AS c2, count(*) AS i FROM u a JOIN u b ON a.p = b.p AND a.c < b.c GROUP BY 1, 2),"
    " s AS (SELECT c1, c2, i::DOUBLE / (x.n + y.n - i) AS iou, i AS intersection, x.n + y.n - i AS un FROM o JOIN z x ON x.c = c1 JOIN z y ON y.c = c2)"
)
_INDICATIVE = "g AS (SELECT * FROM guests WHERE full_name IS NULL OR full_name IN (SELECT full_name FROM guests WHERE full_name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT company) <= 5))"


@query()
def candidate_scores(spark, folder):
    return pipelines.candidate_scores(table(spark, folder, "guests"), "full_name", "company")


@query(f"WITH {_INDICATIVE}, {_SHARED.format(rows='g')} SELECT c1, c2, round(iou, 6) AS iou, intersection::BIGINT AS intersection, un::BIGINT AS \"union\" FROM s")
def indicative_overlaps(spark, folder):
    """candidate_scores of a later round, without the scores of strings."""
    used = mergesets.indicative_persons(table(spark, folder, "guests"), "full_name", "company").where("is_indicative_name")
    return rounded(mergesets.set_overlap(used, "full_name", "company"), "iou")


@query(
    f"WITH RECURSIVE {_SHARED.format(rows='guests')}, m AS (SELECT c1, c2 FROM s WHERE (iou >= 0.1 AND intersection >= 2) OR (iou >= 0.05 AND intersection >= 3)),"
    " e AS (SELECT c1 AS a, c2 AS b FROM m UNION SELECT c2, c1 FROM m), r AS (SELECT a AS t, a AS other FROM e UNION SELECT r.t, e.b FROM r JOIN e ON e.a = r.other),"
    " n AS (SELECT company, count(*) AS n FROM guests WHERE company IS NOT NULL GROUP BY 1), best AS (SELECT t, arg_min(other, (-n.n, other)) AS term FROM r JOIN n ON n.company = other GROUP BY 1)"
    " SELECT guest_id, coalesce(term, company) AS company FROM guests LEFT JOIN best ON t = company"
)
def merge_round(spark, folder):
    """One round of merging: candidates by overlap, their components, and the commonest name of each."""
    guests = table(spark, folder, "guests")
    overlap = mergesets.set_overlap(guests, "full_name", "company").where(mergesets.CONDITIONS["overlap"]())
    return pipelines.merge_round(guests, "company", overlap.select("c1", "c2")).select("guest_id", "company")


@query()
def merged_by_rounds(spark, folder):
    """Three rounds, by the ratio of the names, by the overlap, and by both."""
    rounds = [mergesets.CONDITIONS[c]() for c in ("ratio", "overlap", "both")]
    return pipelines.merged_by_rounds(table(spark, folder, "guests").select("guest_id", "full_name", "company"), "full_name", "company", rounds)


def _interests(spark, folder) -> tuple[DataFrame, DataFrame]:
    sources = {
        "meetings": (table(spark, folder, "guests"), "meeting_id", "company", 0.0008),
        "articles": (table(spark, folder, "article_baskets"), "article", "organization", 0.0002),
    }
    register = table(spark, folder, "entity_database").where("name is not null")
    kinds = register.select(F.col("name").alias("item"), text.mapped_type(F.col("type"), TYPES).alias("sector"))
    return pipelines.interests_map(sources, "pmi", kinds.groupBy("item").agg(F.min("sector").alias("sector")))


def _source_sql(table_: str, basket: str, item: str, support: float, name: str) -> str:
    return (
        f"{name} AS (WITH rel AS (SELECT DISTINCT {basket} AS basket, {item} AS item FROM {table_} WHERE {basket} IS NOT NULL AND {item} IS NOT NULL), tot AS (SELECT count(DISTINCT basket) AS n FROM rel),"
        f" cnt AS (SELECT item, count(*) AS c FROM rel GROUP BY 1), ij AS (SELECT a.item AS item_i, b.item AS item_j, count(*) AS n_ij FROM rel a JOIN rel b ON a.basket = b.basket AND a.item < b.item GROUP BY 1, 2),"
        f" sc AS (SELECT item_i, item_j, ln(n_ij::DOUBLE * n / (x.c::DOUBLE * y.c)) AS score FROM ij JOIN cnt x ON x.item = item_i JOIN cnt y ON y.item = item_j CROSS JOIN tot WHERE n_ij >= n * {support})"
        " SELECT item_i, item_j, score / max(score) OVER () AS score FROM sc)"
    )


_MAP = (
    f"WITH {_source_sql('guests', 'meeting_id', 'company', 0.0008, 'p')}, {_source_sql('article_baskets', 'article', 'organization', 0.0002, 'q')},"
    " k AS (SELECT name AS item, min(CASE WHEN type IN ('municipality','local_council','ministry','statutory_authority','municipal','government') THEN 'government'"
    " WHEN type IN ('private_company','public_company','foreign_company','nonprofit_association','water_corporation','higher_education') THEN 'company' ELSE 'other' END) AS sector FROM entity_database GROUP BY 1),"
    " m AS (SELECT item_i, item_j, max(score) AS score FROM (FROM p UNION ALL FROM q) WHERE score > 0 GROUP BY 1, 2)"
)


@query(
    _MAP + " SELECT item_i, item_j, round(score, 6) AS weight, CASE WHEN (x.sector = 'government' AND y.sector = 'company') OR (x.sector = 'company' AND y.sector = 'government') THEN 1.0 ELSE 0.4 END::DOUBLE AS types"
    " FROM m LEFT JOIN k x ON x.item = item_i LEFT JOIN k y ON y.item = item_j"
)
def interests_map_edges(spark, folder):
    """The map of interests of meetings and articles: its edges."""
    return rounded(_interests(spark, folder)[1], "weight")


@query(
    _MAP + ", i AS (SELECT item_i AS item FROM m UNION SELECT item_j FROM m), c AS (SELECT item, count(DISTINCT b) AS n FROM (SELECT company AS item, 'm' || meeting_id AS b FROM guests UNION ALL SELECT organization, 'a' || article FROM article_baskets) WHERE b IS NOT NULL GROUP BY 1)"
    " SELECT i.item, coalesce(sector, 'other') AS sector, CASE coalesce(sector, 'other') WHEN 'government' THEN 0 WHEN 'company' THEN 1 ELSE 2 END AS sector_num, round(2 * ln(n), 6) AS log_count FROM i LEFT JOIN c USING (item) LEFT JOIN k USING (item)"
)
def interests_map_nodes(spark, folder):
    return rounded(_interests(spark, folder)[0], "log_count")


# --- smaller operators over whole tables -------------------------------------------------------


@query(f"SELECT DISTINCT company AS item FROM guests WHERE company IS NOT NULL AND job_title = 'מנהל אגף' UNION SELECT DISTINCT raw_company FROM guests WHERE raw_company IS NOT NULL AND job_title = 'מנהל אגף'")
def names_of_type(spark, folder):
    rows = table(spark, folder, "guests").withColumnRenamed("job_title", "type")
    return rules.names_of_type(rows, "מנהל אגף", ("company", "raw_company"))


@query(f"WITH {_SHARED.format(rows='guests')}, d AS (SELECT c, sum(iou) AS degree FROM (SELECT c1 AS c, iou FROM s UNION ALL SELECT c2, iou FROM s) GROUP BY 1), t AS (SELECT type AS set_id, name AS member FROM entity_database WHERE name IS NOT NULL)"
       " SELECT set_id, arg_min(member, (-round(coalesce(degree, 0), 6), member)) AS term FROM t LEFT JOIN d ON c = member GROUP BY 1")
def most_similar_member(spark, folder):
    scores = mergesets.set_overlap(table(spark, folder, "guests"), "full_name", "company").select(F.col("c1").alias("a"), F.col("c2").alias("b"), F.col("iou").alias("score"))
    sets = table(spark, folder, "entity_database").where("name is not null").select(F.col("type").alias("set_id"), F.col("name").alias("member"))
    return mergesets.most_similar_member(sets, scores)


@query(f"WITH {_RELATION}, {_COUNTS}, t AS (SELECT item, first_value(item) OVER (PARTITION BY split_part(item, ' ', -1) ORDER BY c DESC, item) AS term FROM cnt),"
       " x AS (SELECT least(a.term, b.term) AS item_i, greatest(a.term, b.term) AS item_j, n_ij FROM ij JOIN t a ON a.item = item_i JOIN t b ON b.item = item_j WHERE a.term <> b.term)"
       " SELECT item_i, item_j, sum(n_ij)::BIGINT AS n FROM x GROUP BY 1, 2")
def pair_rollup(spark, folder):
    relation = baskets.basket_relation(_parts(spark, folder), "l_orderkey", "p_name")
    counts = baskets.item_support(relation).select(F.col("item").alias("name"), F.col("n_item").alias("n"))
    sets = counts.select(F.col("name").alias("member"), text.last_segment(F.col("name"), " ").alias("set_id"))
    pairs = baskets.pair_counts(relation).withColumnRenamed("n_ij", "n")
    return mergesets.rolled_up_pairs(pairs, sets, mergesets.commonest_member(sets, counts))


@query(f"WITH x AS (SELECT organization AS s, count(*) AS n FROM article_baskets WHERE organization IS NOT NULL GROUP BY 1) SELECT s AS term, n::BIGINT AS positive_count FROM x WHERE n > 10")
def valid_terms(spark, folder):
    mentions = table(spark, folder, "article_baskets").where("organization is not null").groupBy(F.col("organization").alias("term")).agg(F.count(F.lit(1)).alias("positive_count"))
    return reconcile.valid_terms(mentions.withColumn("discovery_ratio", F.lit(1.0))).select("term", "positive_count")


@query("SELECT entity_name, arg_max(org_name, (match_id, org_name)) AS org_name FROM org_entity_matches WHERE entity_name IS NOT NULL AND org_name IS NOT NULL GROUP BY 1")
def last_wins(spark, folder):
    rows = table(spark, folder, "org_entity_matches").where("org_name is not null")
    return appointments.last_wins(rows, "entity_name", "org_name", "match_id")


@query("SELECT doc_id, unnest(CASE WHEN text IS NULL OR text = '' THEN [NULL] ELSE string_split(text, chr(10)) END) AS line FROM documents")
def exploded_outer(spark, folder):
    lines = table(spark, folder, "documents").select("doc_id", F.when(F.col("text") != "", F.split("text", "\n")).alias("lines"))
    return text.exploded(lines, "lines", "line", outer=True)


@query("SELECT id, regexp_replace(CASE WHEN starts_with(lower(trim(name_eng)), 'ministry') THEN lower(trim(name_eng)) || ' (israel)' ELSE lower(trim(name_eng)) END, '^the ', '') AS title FROM entity_database")
def looked_up_title(spark, folder):
    return table(spark, folder, "entity_database").select("id", text.looked_up_title(F.col("name_eng"), "israel").alias("title"))


@query("SELECT m.org_name, e.type AS category FROM (SELECT DISTINCT org_name FROM org_entity_matches) m LEFT JOIN (SELECT DISTINCT lower(name_eng) AS t, type FROM entity_database WHERE name_eng IS NOT NULL) e"
       " ON t = regexp_replace(CASE WHEN starts_with(lower(trim(org_name)), 'ministry') THEN lower(trim(org_name)) || ' (israel)' ELSE lower(trim(org_name)) END, '^the ', '')")
def looked_up_categories(spark, folder):
    pages = table(spark, folder, "entity_database").select(F.col("name_eng").alias("title"), F.col("type").alias("category"))
    return pipelines.looked_up(table(spark, folder, "org_entity_matches").select("org_name").distinct(), "org_name", "israel", pages)


@query("SELECT org_name AS name, arg_min(entity_name, (match_id, entity_name)) AS official_name FROM org_entity_matches WHERE org_name IS NOT NULL AND entity_name IS NOT NULL GROUP BY 1")
def official_names(spark, folder):
    rows = table(spark, folder, "org_entity_matches").where("org_name is not null")
    found = rows.select(F.col("org_name").alias("name"), F.col("entity_name").alias("official_name"), F.col("match_id").alias("rank"))
    return pipelines.official_names(rows, "org_name", found)


@query("SELECT guest_id, list_transform(string_split(company, ' '), lambda t: trim(t, '\"')) AS tokens FROM guests WHERE company IS NOT NULL")
def token_quotes(spark, folder):
    rows = table(spark, folder, "guests").where("company is not null")
    return rows.select("guest_id", F.split(text.without_token_quotes(F.col("company")), " ").alias("tokens"))


@query(f"WITH l AS (SELECT guest_id, concat_ws(' - ', full_name, job_title, company) AS s FROM guests), p AS (SELECT guest_id, s, list_transform(regexp_split_to_array(s, ',|{_S}[-–]{_S}'), lambda x: regexp_replace(x, '^{_S}+|{_S}+$', '', 'g')) AS p, position(',' IN s) AS c, length(regexp_extract(s, '^((.|\\n)*?){_S}[-–]{_S}', 1)) + 1 AS d FROM l)"
       f" SELECT guest_id, CASE WHEN c > 0 AND regexp_matches(s, '{_S}[-–]{_S}') AND c < d AND len(p) > 1 THEN list_concat([p[-1]], p[1:-2]) ELSE p END AS parts FROM p")
def row_parts(spark, folder):
    lines = table(spark, folder, "guests").select("guest_id", _guest_line().alias("s"))
    return lines.select("guest_id", text.row_parts(F.col("s")).alias("parts"))


@query("SELECT guest_id, regexp_extract('https://archive.example/2004/' || reference_link || '.html?x', '(http.*html)', 1) AS url FROM guests WHERE reference_link IS NOT NULL")
def inner_urls(spark, folder):
    rows = table(spark, folder, "guests").where("reference_link is not null")
    return rows.select("guest_id", html.inner_url(F.concat(F.lit("https://archive.example/2004/"), F.col("reference_link"), F.lit(".html?x"))).alias("url"))


@query("SELECT guest_id, reference_link AS link, job_title AS shown FROM guests WHERE reference_link IS NOT NULL AND job_title <> ''")
def html_selected(spark, folder):
    rows = table(spark, folder, "guests").where("reference_link is not null and job_title <> ''")
    page = F.concat(F.lit('<select><input id="a" value="no"><input id="b" value="'), _escaped(F.col("reference_link")), F.lit('"></select><p class="y">n</p><p class="x y">'), _escaped(F.col("job_title")), F.lit("</p>"))
    return rows.select("guest_id", html.selected(page, "input", {"id": "b"}, "value").alias("link"), html.selected(page, "p", {"class": "x"}).alias("shown"))


@query(
    _pairs_sql(f"ln({_LIFT})") + f", c AS (SELECT DISTINCT p_name AS item, {_SECTOR} AS sector FROM part), i AS (SELECT item_i AS item FROM s WHERE score > 0 UNION SELECT item_j FROM s WHERE score > 0)"
    " SELECT item, sector, CASE sector WHEN 'government' THEN 0 WHEN 'company' THEN 1 ELSE 2 END AS sector_num, round(2 * ln(cnt.c), 6) AS log_count FROM i JOIN c USING (item) JOIN cnt USING (item)"
)
def graph_node_table(spark, folder):
    """graph_nodes without the clusters."""
    relation = baskets.basket_relation(_parts(spark, folder), "l_orderkey", "p_name")
    none = spark.createDataFrame([], "item string, cluster int")
    return rounded(graph.node_table(relation, _positive(spark, folder), _sectors(spark, folder), none).drop("cluster"), "log_count")


# --- sources and sinks: written into the shared folder and read back ---------------------------


def _place(spark) -> str:
    path = f"{shared_folder(spark)}/linkloom-files-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


_GUESTS = "SELECT guest_id, full_name, company, meeting_date FROM guests"


def _few_columns(spark, folder) -> DataFrame:
    return table(spark, folder, "guests").select("guest_id", "full_name", "company", "meeting_date")


@query("SELECT guest_id, nullif(full_name, '') AS full_name, nullif(company, '') AS company, meeting_date FROM guests")
def csv_round_trip(spark, folder):
    path = _place(spark)
    files.write_csv(_few_columns(spark, folder), path)
    read = files.read_csv(spark, path, "guest_id long, full_name string, company string, meeting_date string")
    return read.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in ("full_name", "company")})


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def csv_of_several_files(spark, folder):
    path = _place(spark)
    for name, key, label in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name")):
        files.write_csv(table(spark, folder, name).select(F.col(key).alias("id"), F.col(label).alias("name")), f"{path}/{name}")
    return files.read_csv(spark, [f"{path}/customer", f"{path}/supplier"], "id long, name string")


@query("SELECT term1, term2 FROM merge_pairs WHERE term1 <> '' AND term2 <> ''")
def headerless_pairs(spark, folder):
    path = _place(spark)
    table(spark, folder, "merge_pairs").where("term1 <> '' and term2 <> ''").select("term1", "term2").write.option("escape", '"').csv(path)
    return files.read_pairs(spark, path)


@query("SELECT n_name, r_name AS file_stem FROM nation JOIN region ON r_regionkey = n_regionkey")
def named_files(spark, folder):
    path = _place(spark)
    rows = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows.select("n_name", "r_name").repartition("r_name").write.option("header", True).partitionBy("r_name").csv(path)
    read = files.read_named_files(spark, path, "n_name string")
    return read.select("n_name", F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "r_name=([^/]*)/", 1)).alias("file_stem"))


@query("SELECT guest_id, right(meeting_date, 4)::INT AS year FROM guests WHERE meeting_date IS NOT NULL")
def written_by_year(spark, folder):
    path = _place(spark)
    files.write_by_year(_few_columns(spark, folder).where("meeting_date is not null"), path, "meeting_date")
    return spark.read.parquet(path).select("guest_id", "year")


@query(_GUESTS)
def written_table(spark, folder):
    path = _place(spark)
    files.write_table(_few_columns(spark, folder), path)
    return spark.read.parquet(path)


@query("SELECT doc_id::VARCHAR AS url, coalesce(text, '') AS text FROM documents")
def documents_log(spark, folder):
    path = _place(spark)
    rows = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("url"), "text")
    for part in (0, 1):  # the log grows
        files.append_documents(rows.where(F.pmod(F.col("url").cast("long"), F.lit(2)) == part), path, "<<END>>", "<<URL>>")
    return files.read_documents(spark, path, "<<END>>", "<<URL>>")


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def text_to_csv(spark, folder):
    """Documents between marks converted to CSV."""
    path = _place(spark)
    rows = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("url"), "text")
    files.append_documents(rows, f"{path}/log", "<<END>>", "<<URL>>")
    files.write_csv(files.read_documents(spark, f"{path}/log", "<<END>>", "<<URL>>"), f"{path}/csv")
    read = files.read_csv(spark, f"{path}/csv", "url string, text string")
    return read.select(F.col("url").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


@query("SELECT DISTINCT trim(formal) AS term FROM nicknames UNION SELECT DISTINCT trim(short_form) FROM nicknames")
def lexicon_file(spark, folder):
    path = _place(spark)
    table(spark, folder, "nicknames").select(F.explode(F.array("formal", "short_form")).alias("t")).select(F.concat(F.lit(" "), "t").alias("value")).write.text(path)
    return files.read_lexicon(spark, path)


@query("SELECT id, name FROM entity_database WHERE name IS NOT NULL")
def json_file(spark, folder):
    path = _place(spark)
    table(spark, folder, "entity_database").where("name is not null").select("id", "name").write.json(path)
    return files.read_json(spark, path, "id long, name string", lines=True)


@query("SELECT DISTINCT type AS sub_type, upper(type) AS type FROM entity_database")
def type_map_file(spark, folder):
    path = _place(spark)
    kinds = table(spark, folder, "entity_database").select("type").distinct()
    pairs = F.map_from_entries(F.collect_list(F.struct("type", F.upper("type"))))  # a few types
    kinds.agg(F.to_json(pairs).alias("value")).coalesce(1).write.text(path)
    return files.read_type_map(spark, path)


@query("SELECT id, coalesce(upper(type), 'other') AS mapped FROM entity_database")
def types_by_table(spark, folder):
    register = table(spark, folder, "entity_database").select("id", "type")
    types = register.select(F.col("type").alias("sub_type"), F.upper("type").alias("type")).distinct()
    return text.with_mapped_type(register, "type", types, "mapped").select("id", "mapped")


@query("SELECT p_name AS term FROM part")
def column_of_file(spark, folder):
    path = _place(spark)
    table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("term")).write.option("header", True).csv(path)
    return files.read_column(spark, path)


@query("SELECT 'https://archive.example/' || strftime(o_orderdate, '%Y%m%d') || '/' || o_orderkey AS url FROM orders WHERE strftime(o_orderdate, '%Y%m%d') BETWEEN '19950101' AND '20041231'")
def snapshot_urls(spark, folder):
    index = table(spark, folder, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("timestamp"), F.col("o_orderkey").cast("string").alias("original"))
    return files.snapshot_urls(index, prefix="https://archive.example/", since="19950101", till="20041231")


@query("SELECT DISTINCT term1 FROM merge_pairs WHERE term1 IN (SELECT term2 FROM merge_pairs WHERE origin = 'manual')")
def approved_terms(spark, folder):
    pairs = table(spark, folder, "merge_pairs")
    labels = pairs.select(F.col("term2").alias("term"), F.when(F.col("origin") == "manual", " Y").otherwise("n").alias("label"))
    return files.approved(pairs.select("term1").distinct(), "term1", labels)


@query("SELECT DISTINCT o_custkey, trim(o_orderpriority) AS priority FROM orders")
def long_table(spark, folder):
    sets = table(spark, folder, "orders").groupBy("o_custkey").agg(F.collect_set(F.concat(F.lit(" "), "o_orderpriority")).alias("s"))
    return files.long_table(sets, "o_custkey", "s", "priority")
