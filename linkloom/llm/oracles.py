"""DuckDB SQL of the pN_ queries that SQL can express."""

_CANON = (
    "array_to_string(list_sort(string_split(trim(regexp_replace(regexp_replace(lower({c}), '[''\"`´‘’‚‛“”„‟′″׳״]', '', 'g'),"
    " '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')), ' ')), ' ')"
)

P3 = (
    "WITH g AS (SELECT guest_id, meeting_id, full_name, job_title IS NULL AS nt, coalesce({company}, '') AS a, coalesce({job}, '') AS b FROM guests"
    " WHERE meeting_id IS NOT NULL AND full_name IS NOT NULL),"
    " k AS (SELECT guest_id, min(guest_id) OVER (PARTITION BY meeting_id, full_name, nt, least(a, b), greatest(a, b)) AS first_guest_id FROM g)"
    " SELECT first_guest_id, guest_id FROM k WHERE guest_id <> first_guest_id"
).format(company=_CANON.format(c="company"), job=_CANON.format(c="job_title"))

P4 = (
    "WITH RECURSIVE t AS (SELECT term1 AS term FROM merge_pairs WHERE term1 IS NOT NULL UNION SELECT term2 FROM merge_pairs WHERE term2 IS NOT NULL),"
    " e AS (SELECT term1 AS a, term2 AS b FROM merge_pairs WHERE term1 <> term2 UNION SELECT term2, term1 FROM merge_pairs WHERE term1 <> term2),"
    " r AS (SELECT term, term AS other FROM t UNION SELECT r.term, e.b FROM r JOIN e ON e.a = r.other)"
    " SELECT min(other) AS group_term, term FROM r GROUP BY term"
)

P6 = (
    "WITH i AS (SELECT DISTINCT 'meeting' AS basket, meeting_id AS k, regexp_replace(lower(company), '[^\\p{L}\\p{N}]+', '', 'g') AS item FROM guests WHERE meeting_id IS NOT NULL AND company IS NOT NULL"
    " UNION SELECT 'article', article, regexp_replace(lower(organization), '[^\\p{L}\\p{N}]+', '', 'g') FROM article_baskets WHERE article IS NOT NULL AND organization IS NOT NULL),"
    " r AS (SELECT * FROM i WHERE item <> ''), n AS (SELECT basket, count(DISTINCT k) AS n FROM r GROUP BY 1),"
    " c AS (SELECT basket, item, count(*) AS n_i FROM r GROUP BY 1, 2), f AS (SELECT r.* FROM r JOIN c USING (basket, item) WHERE n_i >= 6),"
    " p AS (SELECT a.basket, a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM f a JOIN f b ON a.basket = b.basket AND a.k = b.k AND a.item < b.item GROUP BY 1, 2, 3 HAVING count(*) >= 6)"
    " SELECT p.basket, item_a, item_b FROM p JOIN n USING (basket) JOIN c x ON x.basket = p.basket AND x.item = item_a JOIN c y ON y.basket = p.basket AND y.item = item_b"
    " WHERE n_ab * n >= 8 * x.n_i * y.n_i"
)

SQL = {"p3_found": P3, "p4_found": P4, "p6_found": P6}
