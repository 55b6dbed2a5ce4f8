"""DuckDB SQL with the results of the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLAIN_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {PLAIN_WORDS} AS w FROM documents),
b AS (SELECT item_id, {PLAIN_WORDS} AS w FROM benchmark),
b2 AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g
            FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b2)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT rid, n, i, list_slice(w, i, i + n - 1) AS g
          FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT rid, i, n, item_id FROM grams JOIN windows USING (n, g)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid),
item AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
         FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN item USING (rid)
"""
#: Words between ASCII white space.
SPACED_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SPACED_WORDS} AS w FROM documents),
grams AS (SELECT rid, doc_id, i, list_slice(w, i, i + 49) AS g
          FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
shared AS (SELECT g FROM grams GROUP BY g HAVING min(doc_id) < max(doc_id)),
covered AS (SELECT DISTINCT rid, unnest(range(i - 1, i + 49)) AS p FROM grams JOIN shared USING (g)),
runs AS (SELECT rid, min(p) AS a, max(p) + 1 AS b
         FROM (SELECT rid, p, p - row_number() OVER (PARTITION BY rid ORDER BY p) AS run FROM covered) GROUP BY rid, run),
spans AS (SELECT rid, sum(b - a)::BIGINT AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS s FROM runs GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_repeated, coalesce(s, '') AS spans FROM d LEFT JOIN spans USING (rid)
"""

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SPACED_WORDS} AS w FROM documents),
grams AS (SELECT rid, doc_id, i, list_slice(w, i, i + 12) AS g
          FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL)),
least AS (SELECT g, min(doc_id) AS first_id FROM grams GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p FROM grams JOIN least USING (g) WHERE first_id < doc_id),
words AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


def all_sql() -> dict[str, str]:
    return {"op4_positional_index": OP4, "op6_sparse_suffixes": OP6, "op9_suffix_automata": OP9}
