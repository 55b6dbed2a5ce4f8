"""DuckDB twins of the queries over the given page table."""

from oracle.base import PAGES, decode, encoded, pages, path, q, segments, site, top_k
from sitewright import fixed_values as fv

STOPS = "[" + ", ".join(q(w) for w in fv.STOP_WORDS) + "]"
_TOKEN_BREAKS = r"[|–\-:,()\[\]「」【】《》『』、。！？·•\s]+"
_BIGRAM_BREAKS = r"[|–\-:,()\[\]\s]+"


def tokens(x: str) -> str:
    return (f"[w for w in string_split_regex(lower(coalesce({x}, '')), {q(_TOKEN_BREAKS)}) "
            f"if length(w) >= 2]")


def kept_words(x: str) -> str:
    return (f"[w for w in string_split_regex(lower(coalesce({x}, '')), {q(_BIGRAM_BREAKS)}) "
            f"if length(w) >= 2 and not list_contains({STOPS}, w)]")


def bigrams_of(list_column: str) -> str:
    return (f"[{list_column}[i] || ' ' || {list_column}[i + 1] "
            f"for i in range(1, len({list_column}))]")


ANCHOR_TEXT = decode(
    r"regexp_replace(regexp_extract(p, '(?is)^[^>]*>(.*?)(?:</a\s*>|\z)', 1), '<[^>]*>', '', 'g')")
LINKS = rf"""
ln AS (
  SELECT page_id, site, url, pos - 1 AS pos,
    regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) || '://' || host
      || {encoded("href")} AS href, link_text
  FROM (SELECT page_id, site, url, host, generate_subscripts(pieces, 1) AS pos,
               unnest(pieces) AS p,
               unnest([{decode("regexp_extract(p, '(?i)^href=" + chr(34) + "([^" + chr(34) + "]*)" + chr(34) + "', 1)")}
                       for p in pieces]) AS href,
               unnest([trim({ANCHOR_TEXT}) for p in pieces]) AS link_text
        FROM pf))
"""

# Facts of the given pages: no sitemap, robots file, status, meta tags, images or schema in them.
FACTS = r"""
lang AS (
  SELECT site, bool_or(regexp_matches(content, '[฀-๿]')) AS th,
         bool_or(regexp_matches(content, '[a-zA-Z]{3,}')) AS en
  FROM pf GROUP BY site),
tg AS (SELECT site, title, count(*) AS n, min(page_id) AS first_id FROM pf
       WHERE title IS NOT NULL GROUP BY site, title),
tgs AS (SELECT site, count(*) AS n_titles, count(*) FILTER (n > 1) AS n_dup FROM tg GROUP BY site),
facts AS (
  SELECT pf.site, count(*) AS n, min_by(url, page_id) AS first_url,
    count(title) AS titled, count(*) - count(title) AS no_title, count(*) - count(h1) AS no_h1,
    count(*) FILTER (h1_count > 1) AS multi_h1,
    count(*) FILTER (internal_link_count < 3) AS few_links,
    count(*) FILTER (word_count < 300) AS thin, sum(word_count)::BIGINT AS words,
    count(*) FILTER (length(h1) < 15) AS weak_h1,
    count(*) FILTER (has_faq) AS faq, count(*) FILTER (has_contact_info) AS contact,
    count(*) FILTER (len([s for s in string_split(path, '/') if s <> '']) > 4) AS deep,
    any_value(n_titles) AS n_titles, coalesce(any_value(n_dup), 0) AS n_dup,
    bool_or(th) AS th, bool_or(en) AS en,
    min_by(url, page_id) LIKE 'https%' AS is_https
  FROM pf LEFT JOIN tgs ON pf.site = tgs.site LEFT JOIN lang ON pf.site = lang.site
  GROUP BY pf.site),
scores AS (
  SELECT site, is_https,
    greatest(0, least(10, 10 - 3 - 2 - CASE WHEN is_https THEN 0 ELSE 3 END - 1)) AS technical,
    greatest(0, least(10, 10 - CASE WHEN no_title::DOUBLE / n > 0.1::DOUBLE THEN 2 ELSE 0 END - 2
      - CASE WHEN no_h1::DOUBLE / n > 0.1::DOUBLE THEN 2 ELSE 0 END
      - CASE WHEN n_titles < titled * 0.8::DOUBLE THEN 2 ELSE 0 END
      - CASE WHEN th AND en THEN 1 ELSE 0 END - 1
      - CASE WHEN multi_h1::DOUBLE / n > 0.2::DOUBLE THEN 1 ELSE 0 END)) AS onpage,
    greatest(0, least(10, 10 - 2 - 2 - CASE WHEN few_links > n * 0.5::DOUBLE THEN 2 ELSE 0 END
      - CASE WHEN deep > n * 0.3::DOUBLE THEN 1 ELSE 0 END)) AS site_structure,
    greatest(0, least(10, 10 - 2 - least(3, n))) AS ux_ui,
    greatest(0, least(10, 10 - CASE WHEN thin > n * 0.5::DOUBLE THEN 3
      WHEN thin > n * 0.2::DOUBLE THEN 1 ELSE 0 END - 2
      - CASE WHEN faq = 0 THEN 1 ELSE 0 END)) AS content_quality
  FROM facts)
"""
OVERALL = ("greatest(0, least(10, round(technical * 0.25::DOUBLE + onpage * 0.25::DOUBLE "
           "+ site_structure * 0.15::DOUBLE + ux_ui * 0.15::DOUBLE "
           "+ content_quality * 0.20::DOUBLE)))::BIGINT")

REPEATED = r"""
occ AS (SELECT site, page_id, url, unnest(title_keywords) AS keyword FROM pf),
cnt AS (SELECT site, keyword, count(*) AS n_occurrences, count(DISTINCT page_id) AS n_pages
        FROM occ GROUP BY site, keyword),
rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site
          ORDER BY n_occurrences DESC, keyword) AS rank FROM cnt WHERE n_occurrences >= 3)
        WHERE rank <= 5)
"""

ISSUES = rf"""
{REPEATED},
words AS (SELECT site, sum(n_occurrences)::BIGINT AS repeated FROM rep GROUP BY site),
f AS (SELECT facts.*, coalesce(repeated, 0) AS repeated FROM facts LEFT JOIN words USING (site)),
issues AS (
  SELECT site, unnest([
    {{'id': 'no_sitemap_robots', 'rule': 1, 'p': 'critical', 'fires': true, 'n': n, 'e': 1.0}},
    {{'id': 'duplicate_missing_title', 'rule': 2, 'p': 'critical', 'fires': no_title > 0 OR n_dup > 0, 'n': no_title + n_dup, 'e': 1.0}},
    {{'id': 'no_meta_description', 'rule': 3, 'p': 'critical', 'fires': true, 'n': n, 'e': 2.0}},
    {{'id': 'missing_h1', 'rule': 4, 'p': CASE WHEN no_h1 > n * 0.3::DOUBLE THEN 'critical' ELSE 'high' END, 'fires': no_h1 > 0, 'n': no_h1, 'e': 1.0}},
    {{'id': 'no_schema_markup', 'rule': 6, 'p': 'high', 'fires': true, 'n': n, 'e': 5.0}},
    {{'id': 'weak_h1', 'rule': 7, 'p': 'high', 'fires': weak_h1 > 0, 'n': weak_h1, 'e': 1.0}},
    {{'id': 'thin_content', 'rule': 9, 'p': 'high', 'fires': thin > n * 0.3::DOUBLE, 'n': thin, 'e': 14.0}},
    {{'id': 'missing_hreflang', 'rule': 11, 'p': 'medium', 'fires': th AND en, 'n': n, 'e': 2.0}},
    {{'id': 'no_cta', 'rule': 14, 'p': 'medium', 'fires': true, 'n': n, 'e': 3.0}},
    {{'id': 'poor_internal_linking', 'rule': 15, 'p': 'medium', 'fires': few_links > n * 0.4::DOUBLE, 'n': few_links, 'e': 5.0}},
    {{'id': 'multiple_h1', 'rule': 17, 'p': 'medium', 'fires': multi_h1 > 0, 'n': multi_h1, 'e': 1.0}},
    {{'id': 'missing_og_tags', 'rule': 19, 'p': 'medium', 'fires': true, 'n': n, 'e': 2.0}},
    {{'id': 'keyword_cannibalization', 'rule': 23, 'p': 'medium', 'fires': repeated > 0, 'n': repeated, 'e': 7.0}}
  ]) AS i FROM f)
"""
_RANK = "CASE i.p WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END"

FREQ = rf"""
kw0 AS (SELECT site, page_id, page_type, {kept_words('title')} AS tw, {kept_words('h1')} AS hw,
               {tokens('title')} AS tt, {tokens('h1')} AS ht FROM pf),
kw AS (SELECT site, page_id, page_type, unnest(list_distinct(list_concat(tt, ht))) AS keyword FROM kw0
       UNION ALL
       SELECT site, page_id, page_type,
              unnest(list_distinct(list_concat({bigrams_of('tw')}, {bigrams_of('hw')}))) FROM kw0),
kc AS (SELECT site, keyword, count(*) AS n, string_agg(DISTINCT page_type, '|' ORDER BY page_type) AS found_in
       FROM kw GROUP BY site, keyword
       HAVING count(*) >= 2 AND NOT (keyword NOT LIKE '% %' AND list_contains({STOPS}, keyword))),
kf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, keyword) AS rank
                      FROM kc) WHERE rank <= 120)
"""
_TOP_ORDER = "weight DESC, internal_link_count DESC, word_count DESC, page_id"
TOP = rf"""
w AS (SELECT *, 10 AS weight FROM pf),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, page_type, word_count,
         internal_link_count ORDER BY page_id) AS copy FROM w) WHERE copy <= 3),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {_TOP_ORDER}) AS rank
                      FROM dd) WHERE rank <= 40)
"""
CAND = rf"""
cand AS (SELECT DISTINCT site, url, path FROM pf
         WHERE NOT regexp_matches(url, {q(fv.CRAWL_ASSET_PATTERN)})
           AND NOT regexp_matches(url, {q(fv.TRACKING_PATTERN)}))
"""
_DEPTH = f"len({segments('path')})"

# Title tokens as keywords of sites: the site with most pages is ours, the next five compete.
TOKEN_TABLE = rf"""
tok AS (SELECT site, unnest({tokens('title')}) AS keyword FROM pf),
tc AS (SELECT site, keyword, count(*) AS n FROM tok GROUP BY site, keyword),
vol AS (SELECT keyword, sum(n)::BIGINT AS search_volume FROM tc GROUP BY keyword),
ranked AS (SELECT site, keyword, search_volume,
             row_number() OVER (PARTITION BY site ORDER BY n DESC, keyword) AS position
           FROM tc JOIN vol USING (keyword)),
wt AS (SELECT keyword, 1000000 // count(*) AS weight FROM tc GROUP BY 1),
nw AS (SELECT site, count(*) AS n_words FROM tc GROUP BY 1),
ov AS (SELECT a.site, b.site AS competitor, sum(weight)::BIGINT AS overlap, count(*) AS shared_keywords
       FROM tc a JOIN tc b USING (keyword) JOIN wt USING (keyword) WHERE a.site <> b.site GROUP BY 1, 2),
rv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY overlap DESC, competitor) AS rank FROM ov)
       WHERE rank <= 10),
pairs AS (SELECT rv.site, competitor, rank, overlap, shared_keywords, n_words - shared_keywords AS missing_keywords
          FROM rv JOIN nw ON nw.site = competitor),
own AS (SELECT site, lower(keyword) AS key, max(position) AS own_position FROM ranked GROUP BY 1, 2),
joined AS (SELECT p.site, p.competitor, r.keyword, r.position, r.search_volume, o.own_position
           FROM pairs p JOIN ranked r ON r.site = p.competitor
           LEFT JOIN own o ON o.site = p.site AND o.key = lower(r.keyword)),
gaps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, competitor
           ORDER BY search_volume DESC, keyword) AS rank FROM joined WHERE own_position IS NULL)
         WHERE rank <= 10)
"""


def p(*ctes_and_select: str) -> str:
    *ctes, select = ctes_and_select
    return "WITH " + ",".join([PAGES, *ctes]) + " " + select


SQL = {
    "page_table": "SELECT page_id, url, length(html)::BIGINT AS n_chars, 200::BIGINT AS status, "
                  "0::BIGINT AS fetch_ms, NULL::VARCHAR AS final_url, NULL::VARCHAR AS fetch_error FROM pages",
    "page_titles": pages("SELECT page_id, title, coalesce(length(title), 0)::BIGINT AS title_length FROM pf"),
    "page_headings": pages(
        "SELECT page_id, h1, h1_count::BIGINT AS h1_count, h1_count > 1 AS has_multiple_h1, "
        "0::BIGINT AS h2_count, 0::BIGINT AS h3_count, h1_count = 1 AS heading_hierarchy_ok FROM pf"),
    "page_content": pages(
        "SELECT page_id, word_count::BIGINT AS word_count, paragraph_count::BIGINT AS paragraph_count, "
        "substr(content, 1, 2000) AS body_snippet FROM pf"),
    "page_flags": pages(
        "SELECT page_id, has_faq, has_contact_info, false AS has_author, false AS has_date, "
        "false AS has_cta_button, false AS has_table, false AS has_numbered_list, "
        "regexp_matches(content, '(?i)สารบัญ|table of content') AS has_table_of_contents FROM pf"),
    "page_head_signals": pages(
        "SELECT page_id, NULL::VARCHAR AS meta_description, NULL::VARCHAR AS canonical, "
        "NULL::VARCHAR AS meta_robots, false AS viewport, false AS is_noindex, false AS has_og_title, "
        "false AS has_og_image, 0::BIGINT AS n_hreflang, 0::BIGINT AS n_schemas, "
        "0::BIGINT AS image_count, 0::BIGINT AS missing_alt_count, true AS canonical_is_self, "
        "false AS canonical_mismatch, '' AS brand_colors FROM pf"),
    "page_links": p(LINKS, "SELECT page_id, site, pos::BIGINT AS pos, true AS is_internal, href, "
                           "link_text AS text, false AS nofollow FROM ln"),
    "page_nav_items": pages(rf"""
      , nav AS (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS o FROM (
          SELECT page_id, [trim({ANCHOR_TEXT}) for p in string_split_regex(
            regexp_extract(h, '(?is)<nav[^>]*>.*?</nav\s*>', 0), '(?i)<a[\s/]')[2:]] AS l FROM pf)),
      one AS (SELECT page_id, t, min(o) AS o FROM nav WHERE t <> '' AND length(t) < 60 GROUP BY 1, 2)
      SELECT pf.page_id, coalesce(array_to_string((list(t ORDER BY o) FILTER (t IS NOT NULL)), '|'), '')
        AS nav_items FROM pf LEFT JOIN one ON pf.page_id = one.page_id GROUP BY pf.page_id"""),
    "page_types": pages(
        f"SELECT page_id, url, site, path, {_DEPTH}::BIGINT AS depth, page_type FROM pf"),
    "page_title_keywords": pages(
        "SELECT page_id, array_to_string(title_keywords, '|') AS title_keywords FROM pf"),
    "url_parts": pages(
        "SELECT page_id, host, site, path, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, "
        f"{_DEPTH}::BIGINT AS depth, array_to_string([upper(s[1]) || s[2:] for s in {segments('path')}], '/') "
        "AS capitalised FROM pf"),
    "website_base_urls": pages(
        "SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || host AS website_base_url FROM pf"),
    "slug_keywords": pages(
        r"SELECT page_id, CASE WHEN length(k) < 80 THEN k END AS keyword FROM (SELECT page_id, "
        r"coalesce(nullif(trim(regexp_replace(replace(list_extract([s for s in string_split(url, '/') if s <> ''], -1), "
        r"'-', ' '), '(?i)\.(html|php|aspx)$', '')), ''), h1, "
        r"nullif(trim(regexp_replace(title, '[-|–—].*$', '')), '')) AS k FROM pf)"),
    "clean_domains": "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '/.*$', '') AS domain FROM pages",
    "sitemap_url_filter": pages(
        f"SELECT DISTINCT site, url FROM pf WHERE NOT regexp_matches(url, {q(fv.SITEMAP_ASSET_PATTERN)})"),
    "crawl_candidates": p(CAND, "SELECT site, url FROM cand"),
    "crawl_frontier": p(CAND, f"""SELECT site, url, priority, rank FROM ({top_k(
        f'(SELECT site, url, CASE WHEN path = {q("/")} THEN 0::BIGINT ELSE (6 + {_DEPTH})::BIGINT END AS priority FROM cand)',
        'site', 'priority, url', 80)})"""),
    "discovered_urls": pages("SELECT DISTINCT site, url FROM pf"),
    "title_groups": p(FACTS, "SELECT site, title, n AS n_pages, first_id AS first_page_id FROM tg"),
    "site_facts": p(FACTS, """SELECT site, n AS n_pages, no_title, no_h1, thin, words, weak_h1,
        few_links, multi_h1 AS multi_h1, n_dup AS duplicate_titles, n AS n_discovered, deep AS n_deep, is_https,
        array_to_string(list_concat(CASE WHEN en THEN ['en'] ELSE [] END,
          CASE WHEN th THEN ['th'] ELSE [] END), '|') AS languages,
        (en AND th) AS is_multi_language FROM facts"""),
    "site_scores": p(FACTS, f"""SELECT site, technical::BIGINT AS technical, onpage::BIGINT AS onpage,
        site_structure::BIGINT AS site_structure, ux_ui::BIGINT AS ux_ui,
        content_quality::BIGINT AS content_quality, {OVERALL} AS overall,
        CASE WHEN {OVERALL} >= 8 THEN 'A' WHEN {OVERALL} >= 6 THEN 'B' WHEN {OVERALL} >= 4 THEN 'C'
             WHEN {OVERALL} >= 2 THEN 'D' ELSE 'F' END AS grade FROM scores"""),
    "site_strengths": p(FACTS, """SELECT site, unnest(CASE WHEN len(l) > 0 THEN l ELSE ['online'] END) AS strength
        FROM (SELECT site, list_filter([CASE WHEN is_https THEN 'https' END,
          CASE WHEN th AND en THEN 'languages' END, CASE WHEN faq > 0 THEN 'faq' END,
          CASE WHEN contact > n * 0.5::DOUBLE THEN 'contact_info' END], lambda x: x IS NOT NULL) AS l FROM facts)"""),
    "site_summary": p(FACTS, """SELECT site, regexp_extract(first_url, '^([a-zA-Z]+://[^/?#]+)', 1) AS base_url,
        is_https, n AS page_count, n AS discovered_url_count, false AS sitemap_found,
        0::BIGINT AS sitemap_url_count, false AS robots_found FROM facts"""),
    "content_audit": p(FACTS, """SELECT site, false AS has_blog, false AS has_faq_page, false AS has_service,
        0::BIGINT AS blog_count, 0::BIGINT AS avg_fetch_ms, n AS missing_meta_count, no_h1 AS missing_h1_count,
        n AS missing_og_count, 0::BIGINT AS n_slow, 0::BIGINT AS n_noindex FROM facts"""),
    "page_type_counts": p(FACTS, """SELECT site, 0::BIGINT AS home, 0::BIGINT AS product,
        0::BIGINT AS collection, 0::BIGINT AS blog, 0::BIGINT AS service, 0::BIGINT AS faq,
        0::BIGINT AS about, 0::BIGINT AS contact, 0::BIGINT AS policy, n AS other FROM facts"""),
    "site_issues": p(FACTS, ISSUES, f"""SELECT site, i.id AS issue_id, i.p AS priority,
        {_RANK}::BIGINT AS priority_rank, i.rule::BIGINT AS rule_no, i.n::BIGINT AS affected_count,
        i.e::DOUBLE AS effort_days FROM issues WHERE i.fires"""),
    "issue_counts": p(FACTS, ISSUES, """SELECT site, count(*) FILTER (i.p = 'critical') AS critical,
        count(*) FILTER (i.p = 'high') AS high, count(*) FILTER (i.p = 'medium') AS medium,
        0::BIGINT AS low, any_value(greatest(1, is_https::INT + (th AND en)::INT + (faq > 0)::INT
          + (contact > n * 0.5::DOUBLE)::INT))::BIGINT AS strengths
        FROM issues JOIN facts USING (site) WHERE i.fires GROUP BY site"""),
    "issue_order": p(FACTS, ISSUES, f"""SELECT site, row_number() OVER (PARTITION BY site
        ORDER BY {_RANK}, i.rule) AS position, i.id AS issue_id FROM issues WHERE i.fires"""),
    "issue_examples": p(FACTS, ISSUES, f"""SELECT site, issue_id, array_to_string(list(page ORDER BY rank), '|') AS pages
      FROM (
        SELECT * FROM (SELECT site, issue_id, url AS page, k, row_number() OVER (PARTITION BY site, issue_id
                 ORDER BY page_id) AS rank FROM (
            SELECT site, page_id, url, 'no_meta_description' AS issue_id, 4 AS k FROM pf
            UNION ALL SELECT site, page_id, url, 'weak_h1', 4 FROM pf WHERE length(h1) < 15
            UNION ALL SELECT site, page_id, url, 'thin_content', 4 FROM pf WHERE word_count < 300
            UNION ALL SELECT site, page_id, url, 'no_cta', 3 FROM pf
            UNION ALL SELECT site, page_id, url, 'poor_internal_linking', 4 FROM pf WHERE internal_link_count < 3
            UNION ALL SELECT site, page_id, url, 'missing_og_tags', 3 FROM pf)) WHERE rank <= k)
      GROUP BY site, issue_id"""),
    "page_tokens": pages(
        f"SELECT page_id, array_to_string({tokens('title')}, '|') AS tokens FROM pf"),
    "page_bigrams": pages(
        f"SELECT page_id, array_to_string({bigrams_of('tw')}, '|') AS bigrams "
        f"FROM (SELECT page_id, {kept_words('title')} AS tw FROM pf)"),
    "keyword_frequency": p(FREQ, "SELECT site, rank, keyword, n, found_in FROM kf"),
    "seed_keywords": p(FREQ, "SELECT site, rank, keyword FROM kf WHERE rank <= 10 AND length(keyword) >= 3"),
    "request_keywords": p(FREQ, f"SELECT site, rank, keyword FROM ({top_k('(SELECT site, rank AS r, keyword FROM kf WHERE rank <= 10 AND length(keyword) >= 3)', 'site', 'r', 5)})"),
    "verified_keywords": p(FREQ, "SELECT site, rank, keyword FROM kf WHERE rank <= 20"),
    "url_patterns": pages(rf"""SELECT site, rank, pattern, n, example FROM ({top_k(
        f'''(SELECT site, pattern, count(*) AS n, min(url) AS example FROM (
           SELECT DISTINCT site, url, '/' || array_to_string(({segments('path')})[1:least(2, {_DEPTH} - 1)], '/')
             || CASE WHEN {_DEPTH} > 1 THEN '/...' ELSE '' END AS pattern FROM pf WHERE {_DEPTH} > 0)
           GROUP BY site, pattern)''', 'site', 'n DESC, pattern', 20)})"""),
    "token_cannibalization": pages(rf"""
        , occ AS (SELECT site, page_id, url, unnest([t for t in {tokens('title')} if length(t) >= 4]) AS keyword FROM pf),
        cnt AS (SELECT site, keyword, count(*) AS n_occurrences, count(DISTINCT page_id) AS n_pages FROM occ GROUP BY 1, 2),
        rep AS ({top_k('(SELECT * FROM cnt WHERE n_occurrences >= 3)', 'site', 'n_occurrences DESC, keyword', 10)}),
        ex AS ({top_k('occ', 'site, keyword', 'page_id, url', 5, 'pos')})
        SELECT rep.site, rep.rank, rep.keyword, any_value(n_occurrences) AS n_occurrences,
          any_value(n_pages) AS n_pages, array_to_string(list(url ORDER BY pos), '|') AS pages
        FROM rep JOIN ex ON rep.site = ex.site AND rep.keyword = ex.keyword GROUP BY 1, 2, 3""").replace(
        ") \n        , occ", "), occ"),
    "title_cannibalization": p(REPEATED, f""" , ex AS ({top_k('occ', 'site, keyword', 'page_id, url', 2, 'pos')})
        SELECT rep.site, rep.rank, rep.keyword, any_value(n_occurrences) AS n_occurrences,
          any_value(n_pages) AS n_pages, array_to_string(list(url ORDER BY pos), '|') AS pages
        FROM rep JOIN ex ON rep.site = ex.site AND rep.keyword = ex.keyword GROUP BY 1, 2, 3"""),
    "top_pages": p(TOP, "SELECT site, rank, page_id, url, page_type, title, h1, "
                        "word_count::BIGINT AS word_count, internal_link_count::BIGINT AS internal_link_count FROM tp"),
    "distinct_looking_pages": p(TOP, "SELECT site, page_id, copy FROM dd"),
    "context_pages": pages(
        f"SELECT site, rank, page_id, word_count::BIGINT AS word_count FROM ({top_k('pf', 'site', 'word_count DESC, page_id', 20)})"),
    "verified_urls": pages(f"SELECT site, rank, url FROM ({top_k('pf', 'site', 'page_id', 15)})"),
    "page_title_lines": pages(
        f"SELECT site, rank, page_type || '|' || url || '|' || replace(coalesce(title, ''), '|', ' ') AS line "
        f"FROM ({top_k('pf', 'site', 'page_id', 100)})"),
    "recommended_sitemap": pages(f"""SELECT s.site, coalesce(array_to_string(list(o.path ORDER BY rank)
          FILTER (o.path IS NOT NULL), '|'), '') AS other, 1 + least(5, count(o.path)) AS total_urls
        FROM (SELECT DISTINCT site FROM pf) s LEFT JOIN ({top_k(f'''(SELECT DISTINCT site, url, path FROM pf
          WHERE path <> '/' AND NOT regexp_matches(path, {q(fv.OTHER_PATH_FILE_PATTERN)})
            AND NOT regexp_matches(path, {q(fv.OTHER_PATH_SYSTEM_PATTERN)}) AND {_DEPTH} <= 3)''',
          'site', 'url', 10)}) o ON s.site = o.site GROUP BY s.site"""),
    "site_rivals": p(TOKEN_TABLE, "SELECT site, rank, competitor, overlap, shared_keywords, missing_keywords FROM pairs"),
    "own_and_competitor_keywords": p(TOKEN_TABLE, "SELECT * FROM joined"),
    "keyword_gaps": p(TOKEN_TABLE, "SELECT site, competitor, keyword, position, search_volume, rank FROM gaps"),
}


def _tidy(sql: str) -> str:
    # A fragment that continues the WITH list starts with a comma.
    import re
    return re.sub(r"\)\s+, ", "), ", sql)


SQL = {k: _tidy(v) for k, v in SQL.items()}
__all__ = ["SQL", "path", "site"]
