"""DuckDB twins of the queries over tables derived from the given ones.

The pages built around documents are never rendered here: the expected feature of a page follows
from the number of its document, so markup reading is checked against an independent statement.
"""

from oracle.base import PAGES, collapse, q, top_k
from oracle.pages_sql import TOKEN_TABLE
from sitewright import fixed_values as fv

_PATH = """CASE id % 13 WHEN 0 THEN '/' WHEN 1 THEN '/products/item-' || id || '/'
  WHEN 2 THEN '/category/c' || id || '/' WHEN 3 THEN '/service/s-' || id || '/'
  WHEN 4 THEN '/faq-' || id WHEN 5 THEN '/about-' || id WHEN 6 THEN '/contact-' || id
  WHEN 7 THEN '/podcast/' || id || '/' WHEN 8 THEN '/blog/post-' || id || '/'
  WHEN 9 THEN '/policy-' || id WHEN 10 THEN '/a/b/c/d/e-' || id WHEN 11 THEN '/x-' || id
  ELSE '/news/' || id || '/' END"""
_TYPES = ("home", "product", "category", "service", "faq", "about", "contact", "podcast", "blog",
          "policy", "other", "other", "blog")
_TYPE = "CASE id % 13 " + " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(_TYPES)) + " END"
_WORDS = [
    "CASE WHEN id % 9 <> 4 THEN h1 END", "CASE WHEN id % 9 = 5 THEN 'Second' END",
    "array_to_string(['Part ' || j for j in range(1, id % 4 + 1)], ' ')",
    "array_to_string(['Step ' || j for j in range(1, id % 3 + 1)], ' ')", "text",
    "CASE WHEN id % 5 = 2 THEN 'Cell' END", "CASE WHEN id % 6 = 4 THEN 'OneTwoThree' END",
    "CASE WHEN id % 4 = 1 THEN 'Buy now' END", "CASE WHEN id % 8 = 3 THEN 'Order here' END",
    "CASE WHEN id % 16 = 5 THEN 'QaQbQcQd' END", "CASE WHEN id % 9 = 2 THEN 'Contents' END",
    "CASE WHEN id % 5 = 3 THEN 'By Ann' END", "CASE WHEN id % 7 = 2 THEN '2 January' END",
    "array_to_string(['Product ' || j for j in range(1, id % 5 + 1)], ' ')",
    "CASE WHEN id % 3 = 0 THEN 'Partner' END", "CASE WHEN id % 4 = 2 THEN 'Sub' END",
    "CASE WHEN id % 2 = 0 THEN 'Mail' END", "CASE WHEN id % 6 = 5 THEN 'Call 0812345678' END",
]
_MAIN = f"array_to_string(list_filter([{', '.join(_WORDS)}], lambda s: s IS NOT NULL AND s <> ''), ' ')"

RICH = rf"""
r0 AS (SELECT doc_id AS id, lang, source, text, doc_id % 7 AS k,
         CASE WHEN doc_id % 2 = 0 THEN 'www.' ELSE '' END || 'shop' || (doc_id % 7) || '.example.com' AS host,
         CASE WHEN doc_id % 4 = 0 THEN 'Short ' || doc_id
              ELSE 'Heading number ' || doc_id || ' of shop ' || (doc_id % 7) END AS h1,
         doc_id % 17 <> 16 AS got
       FROM documents),
r1 AS (SELECT *, 'https://' || host || ({_PATH}) AS url, ({_PATH}) AS path,
         {collapse(_MAIN)} AS main_text FROM r0),
r2 AS (SELECT *, CASE WHEN length(main_text) > 50 THEN main_text
         ELSE 'HomeItem ' || k || CASE k WHEN 3 THEN 'RAW_NAME' WHEN 5 THEN '{{menu}}' ELSE '' END
              || ' ' || main_text || ' Footer text' END AS content FROM r1),
rf AS (SELECT id, id AS page_id, k, lang, host, 'shop' || k || '.example.com' AS site, url, path, got, content,
    CASE id % 11 WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 200 END AS status, (id * 37) % 7000 AS fetch_ms,
    CASE WHEN got THEN {_TYPE} ELSE 'other' END AS page_type,
    CASE WHEN NOT got OR id % 9 = 8 THEN NULL WHEN id % 5 = 0 THEN 'Shared title ' || lang
         ELSE 'Page ' || id || ' about ' || source || ' & more' END AS title,
    CASE WHEN NOT got THEN NULL WHEN id % 3 <> 0 THEN 'Summary of ' || id || ' in ' || lang
         WHEN id % 6 = 3 THEN 'Short ' || id END AS meta_description,
    CASE WHEN got AND id % 10 = 3 THEN 'noindex, nofollow' END AS meta_robots,
    CASE WHEN got THEN CASE id % 4 WHEN 1 THEN url WHEN 2 THEN 'https://shop' || k || '.example.com/other/' || id
         WHEN 3 THEN 'https://other.example.net/' || id END END AS canonical,
    got AND id % 8 <> 0 AS viewport,
    got AND id % 6 IN (1, 2) AS has_og_title, got AND id % 6 IN (2, 3) AS has_og_image,
    got AND id % 6 = 2 AS has_og_description,
    CASE WHEN got AND id % 5 = 1 THEN 2 ELSE 0 END AS n_hreflang,
    CASE WHEN NOT got THEN 0 ELSE CASE id % 12 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 4 ELSE 0 END END AS n_schemas,
    got AND id % 12 = 0 AS has_org, got AND id % 12 = 1 AS has_product, got AND id % 12 = 2 AS has_faq_schema,
    got AND id % 12 = 0 AS has_breadcrumb, got AND id % 12 = 3 AS has_article,
    CASE WHEN got AND id % 9 <> 4 THEN h1 END AS h1,
    CASE WHEN NOT got THEN 0 WHEN id % 9 = 4 THEN 0 WHEN id % 9 = 5 THEN 2 ELSE 1 END AS h1_count,
    CASE WHEN got THEN id % 4 ELSE 0 END AS h2_count, CASE WHEN got THEN id % 3 ELSE 0 END AS h3_count,
    CASE WHEN got THEN id % 4 ELSE 0 END AS image_count,
    CASE WHEN got THEN greatest(0, id % 4 - 1) ELSE 0 END AS missing_alt_count,
    got AND id % 5 = 2 AS has_table, got AND id % 6 = 4 AS has_numbered_list,
    got AND (id % 4 = 1 OR id % 8 = 3) AS has_cta_button,
    got AND (id % 13 = 4 OR id % 16 = 5) AS has_faq, got AND id % 9 = 2 AS has_toc,
    got AND id % 5 = 3 AS has_author, got AND id % 7 = 2 AS has_date,
    CASE WHEN got THEN 2 + (k IN (3, 5))::INT + id % 5 + (id % 4 = 2)::INT + (id % 8 = 3)::INT ELSE 0 END AS internal_link_count,
    CASE WHEN got AND id % 3 = 0 THEN 1 ELSE 0 END AS external_nofollow_count,
    CASE WHEN got THEN len(regexp_extract_all(content, '[^ ]{{2,}}')) ELSE 0 END AS word_count,
    got AND regexp_matches(content, '(?i)(\+66|0[0-9]{{8,9}}|@|line\.me|facebook\.com|LINE ID)') AS has_contact_info
  FROM r2)
"""

_L = "(status = 200 OR status IS NULL)"
_KEY = "page_type IN ('home', 'product', 'category', 'blog')"


def _count(name: str, cond: str) -> str:
    return f"count(*) FILTER ({cond}) AS {name}"


FACTS = rf"""
tg AS (SELECT site, title, count(*) FILTER (status = 200) AS n_ok, count(*) FILTER ({_L}) AS n_live
       FROM rf WHERE title IS NOT NULL GROUP BY 1, 2),
tgs AS (SELECT site, count(*) FILTER (n_ok > 0) AS ok_titles, count(*) FILTER (n_live > 1) AS dup FROM tg GROUP BY 1),
du AS (SELECT site, count(*) AS n_disc, count(*) FILTER (path LIKE '/a/b/c/d/%') AS deep
       FROM (SELECT DISTINCT site, url, path FROM rf) GROUP BY 1),
kwo AS (SELECT site, page_id, unnest([w for w in [regexp_replace(t, '[^a-z0-9ก-๙]', '', 'g')
           for t in string_split_regex(lower(title), '[\s|,\-–—:]+')] if length(w) >= 3]) AS kw
        FROM rf WHERE {_L} AND title IS NOT NULL),
kwc AS (SELECT site, kw, count(*) AS n FROM kwo GROUP BY 1, 2 HAVING count(*) >= 3),
kwt AS (SELECT site, sum(n)::BIGINT AS repeated FROM ({top_k('kwc', 'site', 'n DESC, kw', 5)}) GROUP BY site),
hn AS (SELECT site, k, min(page_id) AS home_id FROM rf WHERE page_type = 'home' GROUP BY 1, 2),
fp AS (SELECT site, min_by(has_org, page_id) FILTER (page_type = 'home') AS home_org,
              min_by(has_product, page_id) FILTER (page_type = 'product') AS prod_schema,
              min_by(has_faq_schema, page_id) FILTER (has_faq OR page_type = 'faq') AS faq_schema
       FROM rf WHERE {_L} GROUP BY 1),
fc AS (
  SELECT site, count(*) AS n_pages, count(*) FILTER (status = 200) AS n_ok, count(*) FILTER ({_L}) AS n,
    {_count('broken', 'status >= 400')}, {_count('no_canonical', 'canonical IS NULL')},
    {_count('mismatch', "canonical LIKE '%other.example.net%'")},
    {_count('noindex_key', f'meta_robots IS NOT NULL AND {_KEY}')}, avg(fetch_ms)::DOUBLE AS mean_ms,
    {_count('ok_no_title', 'status = 200 AND title IS NULL')}, {_count('ok_titled', 'status = 200 AND title IS NOT NULL')},
    {_count('ok_no_meta', 'status = 200 AND meta_description IS NULL')}, {_count('ok_no_h1', 'status = 200 AND h1 IS NULL')},
    {_count('ok_hreflang', 'status = 200 AND n_hreflang > 0')},
    {_count('ok_no_og', 'status = 200 AND NOT (has_og_title AND has_og_image)')},
    {_count('ok_multi', 'status = 200 AND h1_count > 1')}, {_count('ok_no_bc', 'status = 200 AND NOT has_breadcrumb')},
    {_count('ok_few', 'status = 200 AND internal_link_count < 3')}, {_count('ok_no_cta', 'status = 200 AND NOT has_cta_button')},
    {_count('ok_no_vp', 'status = 200 AND NOT viewport')}, {_count('ok_alt', 'status = 200 AND missing_alt_count > 0')},
    {_count('ok_no_contact', "status = 200 AND NOT has_contact_info AND page_type IN ('home', 'contact')")},
    {_count('ok_thin', 'status = 200 AND word_count < 300')}, {_count('ok_no_schema', 'status = 200 AND n_schemas = 0')},
    {_count('ok_prod', "status = 200 AND page_type = 'product'")},
    {_count('ok_short', "status = 200 AND page_type = 'product' AND length(title) < 20")},
    {_count('ok_faq', "status = 200 AND (has_faq OR page_type = 'faq')")}, {_count('ok_blog', "status = 200 AND page_type = 'blog'")},
    {_count('ok_blog_na', "status = 200 AND page_type = 'blog' AND NOT has_author")},
    {_count('ok_cat', "status = 200 AND page_type = 'category'")}, {_count('ok_contact', 'status = 200 AND has_contact_info')},
    {_count('no_title', f'{_L} AND title IS NULL')}, {_count('no_meta', f'{_L} AND meta_description IS NULL')},
    {_count('no_h1', f'{_L} AND h1 IS NULL')}, {_count('weak_h1', f'{_L} AND length(h1) < 15')},
    {_count('no_schema', f'{_L} AND n_schemas = 0')}, {_count('prod', f"{_L} AND page_type = 'product'")},
    {_count('code', f"{_L} AND page_type = 'product' AND length(regexp_replace(title, '[^a-zA-Z0-9]', '', 'g')) < 15")},
    {_count('thin', f'{_L} AND word_count < 300')}, {_count('no_hreflang', f'{_L} AND n_hreflang = 0')},
    {_count('no_bc', f"{_L} AND NOT has_breadcrumb AND page_type IN ('product', 'category', 'blog')")},
    {_count('alt', f'{_L} AND missing_alt_count > 0')}, {_count('no_cta', f"{_L} AND NOT has_cta_button AND page_type <> 'policy'")},
    {_count('few', f'{_L} AND internal_link_count < 3')}, {_count('noindex', f'{_L} AND meta_robots IS NOT NULL')},
    {_count('noindex_imp', f'{_L} AND meta_robots IS NOT NULL AND {_KEY}')}, {_count('multi', f'{_L} AND h1_count > 1')},
    {_count('bad_h', f'{_L} AND h1 IS NOT NULL AND h3_count > 0 AND h2_count = 0')},
    {_count('no_og', f'{_L} AND NOT (has_og_title AND has_og_image)')},
    {_count('live_mismatch', f"{_L} AND canonical LIKE '%other.example.net%'")},
    {_count('no_can_typed', f"{_L} AND canonical IS NULL AND page_type <> 'other'")},
    {_count('slow', f'{_L} AND fetch_ms > 3000')}, round(avg(fetch_ms) FILTER ({_L})) AS live_ms,
    {_count('no_h2', f"{_L} AND page_type IN ('home', 'product', 'category', 'blog', 'service') AND h2_count = 0 AND word_count > 200")},
    any_value(k) AS k
  FROM rf GROUP BY site),
f AS (SELECT fc.*, ok_titles, dup, n_disc, deep, coalesce(repeated, 0) AS repeated, home_id IS NOT NULL AS has_home,
        (k = 3 AND home_id IS NOT NULL)::INT AS nav_raw
      FROM fc LEFT JOIN tgs USING (site) LEFT JOIN du USING (site) LEFT JOIN kwt USING (site)
        LEFT JOIN (SELECT site, home_id FROM hn) h USING (site)),
sc AS (SELECT site,
    greatest(0, least(10, 10 - 3 - 2 - least(2, broken) - (no_canonical > n_pages * 0.5::DOUBLE)::INT
      - least(2, mismatch) - least(2, noindex_key)
      - CASE WHEN mean_ms > 5000 THEN 2 WHEN mean_ms > 3000 THEN 1 ELSE 0 END)) AS technical,
    greatest(0, least(10, 10 - 2 * (ok_no_title::DOUBLE / n_ok > 0.1::DOUBLE)::INT
      - 2 * (ok_no_meta::DOUBLE / n_ok > 0.2::DOUBLE)::INT - 2 * (ok_no_h1::DOUBLE / n_ok > 0.1::DOUBLE)::INT
      - 2 * (ok_titles < ok_titled * 0.8::DOUBLE)::INT - (ok_hreflang < n_ok * 0.5::DOUBLE)::INT
      - (ok_no_og::DOUBLE / n_ok > 0.6::DOUBLE)::INT - (ok_multi::DOUBLE / n_ok > 0.2::DOUBLE)::INT)) AS onpage,
    greatest(0, least(10, 10 - 2 - 2 * (ok_no_bc > n_ok * 0.7::DOUBLE)::INT - 2 * (ok_few > n_ok * 0.5::DOUBLE)::INT
      - (deep > n_disc * 0.3::DOUBLE)::INT - nav_raw - least(2, broken))) AS site_structure,
    greatest(0, least(10, 10 - 2 * (ok_no_cta > n_ok * 0.5::DOUBLE)::INT - least(3, ok_no_vp)
      - (ok_alt > n_ok * 0.4::DOUBLE)::INT - 2 * nav_raw - (ok_no_contact > 0)::INT)) AS ux_ui,
    greatest(0, least(10, 10 - CASE WHEN ok_thin > n_ok * 0.5::DOUBLE THEN 3 WHEN ok_thin > n_ok * 0.2::DOUBLE THEN 1 ELSE 0 END
      - 2 * (ok_no_schema > n_ok * 0.7::DOUBLE)::INT - 2 * (ok_short > ok_prod * 0.5::DOUBLE)::INT - (ok_faq = 0)::INT
      - (ok_blog > 0 AND ok_blog_na > ok_blog * 0.5::DOUBLE)::INT)) AS content_quality
  FROM f)
"""


def _issue(issue_id: str, rule: int, priority: str, fires: str, n: str) -> str:
    return (f"SELECT site, {q(issue_id)} AS issue_id, {rule}::BIGINT AS rule_no, {priority} AS priority, "
            f"({n})::BIGINT AS affected_count FROM f WHERE {fires}")


ISSUES = " UNION ALL ".join([
    _issue("no_sitemap_robots", 1, "'critical'", "true", "n"),
    _issue("duplicate_missing_title", 2, "'critical'", "no_title > 0 OR dup > 0", "no_title + dup"),
    _issue("no_meta_description", 3, "'critical'", "no_meta > n * 0.15::DOUBLE", "no_meta"),
    _issue("missing_h1", 4, "CASE WHEN no_h1 > n * 0.3::DOUBLE THEN 'critical' ELSE 'high' END", "no_h1 > 0", "no_h1"),
    _issue("broken_nav_items", 5, "'high'", "nav_raw > 0", "nav_raw"),
    _issue("no_schema_markup", 6, "'high'", "no_schema > n * 0.4::DOUBLE", "no_schema"),
    _issue("weak_h1", 7, "'high'", "weak_h1 > 0", "weak_h1"),
    _issue("product_title_model_code_only", 8, "'high'", "code > prod * 0.3::DOUBLE AND code > 0", "code"),
    _issue("thin_content", 9, "'high'", "thin > n * 0.3::DOUBLE", "thin"),
    _issue("broken_pages", 10, "CASE WHEN broken > 3 THEN 'critical' ELSE 'high' END", "broken > 0", "broken"),
    _issue("missing_hreflang", 11, "'medium'", "no_hreflang > n * 0.4::DOUBLE", "no_hreflang"),
    _issue("no_breadcrumb", 12, "'medium'", "no_bc > 0", "no_bc"),
    _issue("missing_alt_text", 13, "'medium'", "alt > 0", "alt"),
    _issue("no_cta", 14, "'medium'", "no_cta > n * 0.4::DOUBLE", "no_cta"),
    _issue("poor_internal_linking", 15, "'medium'", "few > n * 0.4::DOUBLE", "few"),
    _issue("noindex_pages", 16, "CASE WHEN noindex_imp > 0 THEN 'high' ELSE 'medium' END", "noindex > 0", "noindex"),
    _issue("multiple_h1", 17, "'medium'", "multi > 0", "multi"),
    _issue("heading_hierarchy", 18, "'medium'", "bad_h > 0", "bad_h"),
    _issue("missing_og_tags", 19, "'medium'", "no_og > n * 0.5::DOUBLE", "no_og"),
    _issue("canonical_mismatch", 20, "'high'", "live_mismatch > 0", "live_mismatch"),
    _issue("missing_canonical", 21, "'medium'", "no_can_typed > n * 0.5::DOUBLE", "no_can_typed"),
    _issue("slow_server_response", 22, "CASE WHEN live_ms > 5000 THEN 'high' ELSE 'medium' END",
           "slow > n * 0.3::DOUBLE OR live_ms > 3000", "slow"),
    _issue("keyword_cannibalization", 23, "'medium'", "repeated > 0", "repeated"),
    _issue("no_h2_structure", 24, "'medium'", "no_h2 > 2", "no_h2"),
])
OVERALL = ("greatest(0, least(10, round(technical * 0.25::DOUBLE + onpage * 0.25::DOUBLE + site_structure * 0.15::DOUBLE "
           "+ ux_ui * 0.15::DOUBLE + content_quality * 0.20::DOUBLE)))::BIGINT")


def rich(*parts: str) -> str:
    *ctes, select = parts
    return "WITH " + ", ".join([RICH, *ctes]) + " " + select


_BUCKET = ("CASE WHEN page_type = 'category' THEN 'collections' WHEN page_type IN ('faq', 'about', 'contact', 'policy') "
           "THEN 'pages' WHEN page_type = 'blog' THEN 'blogs' END")
SITEMAP = f"""
bk AS (SELECT site, {_BUCKET} AS bucket, path, min(page_id) AS first_id FROM rf WHERE {_BUCKET} IS NOT NULL GROUP BY 1, 2, 3),
cp AS (SELECT * FROM ({top_k('bk', 'site, bucket', 'first_id, path', 15)}) WHERE bucket = 'collections' OR rank <= 10),
ot AS ({top_k(f'''(SELECT DISTINCT site, url, path FROM rf WHERE path <> '/' AND path NOT LIKE '/a/b/c/d/%'
   AND NOT regexp_matches(path, {q(fv.OTHER_PATH_SYSTEM_PATTERN)})
   AND (site, path) NOT IN (SELECT (site, path) FROM bk))''', 'site', 'url', 10)}),
al AS (SELECT site, bucket, path, rank FROM cp UNION ALL SELECT site, 'other', path, rank FROM ot)
"""


def _bucket(name: str) -> str:
    return f"coalesce(array_to_string(list(path ORDER BY rank) FILTER (bucket = {q(name)}), '|'), '') AS {name}"


def _evidence(issue: str, k: int, cond: str, **fields: str) -> str:
    given = ", ".join(f"({fields.get(n, 'NULL')})::{'BIGINT' if n == 'status' else 'VARCHAR'} AS {n}" for n in ("url", "page", "label", "current", "status", "value", "note"))
    return (f"SELECT site, {q(issue)} AS issue_id, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS at, {given} "
            f"FROM rf WHERE {cond} QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id) <= {k}")


_P = {"page": "rf.url"}
EVIDENCE = f"""
kwp AS (SELECT o.site, o.kw, o.page_id, r.path, row_number() OVER (PARTITION BY o.site, o.kw ORDER BY o.page_id) AS g
        FROM kwo o JOIN rf r USING (page_id)),
kwl AS (SELECT t.site, t.kw, t.n, t.rank, array_to_string(list(path ORDER BY g) FILTER (g <= 2), ', ') AS paths
        FROM ({top_k('kwc', 'site', 'n DESC, kw', 5)}) t JOIN kwp USING (site, kw) GROUP BY ALL),
tgf AS (SELECT site, title, count(*) AS n, min(page_id) AS first_id FROM rf WHERE title IS NOT NULL AND {_L} GROUP BY 1, 2 HAVING count(*) > 1),
ev AS (""" + " UNION ALL ".join([
    _evidence("no_meta_description", 4, f"{_L} AND meta_description IS NULL", **_P, value="word_count"),
    _evidence("missing_h1", 4, f"{_L} AND h1 IS NULL", **_P),
    _evidence("weak_h1", 4, f"{_L} AND length(h1) < 15", **_P, current="h1"),
    _evidence("product_title_model_code_only", 4, f"{_L} AND page_type = 'product' AND length(regexp_replace(title, '[^a-zA-Z0-9]', '', 'g')) < 15", **_P, current="title"),
    _evidence("thin_content", 4, f"{_L} AND word_count < 300", **_P, value="word_count"),
    _evidence("missing_alt_text", 4, f"{_L} AND missing_alt_count > 0", **_P, value="missing_alt_count"),
    _evidence("no_cta", 3, f"{_L} AND NOT has_cta_button AND page_type <> 'policy'", **_P),
    _evidence("poor_internal_linking", 4, f"{_L} AND internal_link_count < 3", **_P, value="internal_link_count", note="'internal links'"),
    _evidence("noindex_pages", 5, f"{_L} AND meta_robots IS NOT NULL", **_P, current="meta_robots", note="page_type"),
    _evidence("multiple_h1", 4, f"{_L} AND h1_count > 1", **_P, value="h1_count", note="'H1 tags'"),
    _evidence("heading_hierarchy", 4, f"{_L} AND h1 IS NOT NULL AND h3_count > 0 AND h2_count = 0", **_P, current="'H1:1, H2:' || h2_count || ', H3:' || h3_count"),
    _evidence("missing_og_tags", 3, f"{_L} AND NOT (has_og_title AND has_og_image)", **_P,
              note="'og:title: ' || CASE WHEN has_og_title THEN 'yes' ELSE 'no' END || ' og:image: ' || CASE WHEN has_og_image THEN 'yes' ELSE 'no' END"),
    _evidence("canonical_mismatch", 4, f"{_L} AND canonical LIKE '%other.example.net%'", **_P, current="canonical"),
    _evidence("missing_canonical", 4, f"{_L} AND canonical IS NULL AND page_type <> 'other'", **_P, note="page_type"),
    _evidence("slow_server_response", 4, f"{_L} AND fetch_ms > 3000", **_P, value="printf('%.1fs', fetch_ms / 1000.0::DOUBLE)"),
    _evidence("no_h2_structure", 4, f"{_L} AND page_type IN ('home', 'product', 'category', 'blog', 'service') AND h2_count = 0 AND word_count > 200", **_P, note="page_type"),
    _evidence("broken_pages", 5, "status >= 400", url="rf.url", status="status"),
    "SELECT site, 'duplicate_missing_title' AS issue_id, CASE WHEN o = 0 THEN g - 1 ELSE g - 1 + least(3, (SELECT count(*) FROM rf x WHERE x.site = u.site "
    f"AND x.title IS NULL AND (x.status = 200 OR x.status IS NULL))) END AS at, NULL::VARCHAR AS url, page, NULL::VARCHAR AS label, "
    "t AS current, NULL::BIGINT AS status, n::VARCHAR AS value, NULL::VARCHAR AS note FROM ("
    f"SELECT site, 0 AS o, row_number() OVER (PARTITION BY site ORDER BY page_id) AS g, NULL AS t, url AS page, NULL AS n FROM rf WHERE {_L} AND title IS NULL "
    "UNION ALL SELECT site, 1, row_number() OVER (PARTITION BY site ORDER BY first_id, title), title, NULL, n FROM tgf) u WHERE g <= 3",
    "SELECT site, 'keyword_cannibalization' AS issue_id, rank - 1 AS at, NULL AS url, NULL AS page, '\"' || kw || '\"' AS label, NULL AS current, NULL AS status, n::VARCHAR AS value, paths AS note FROM kwl",
]) + ")"

_MISSING = ", ".join([
    "CASE WHEN id % 5 = 1 THEN 'salesPitchSummary' END", "CASE WHEN id % 7 = 2 THEN 'executiveSummary' END",
    "CASE WHEN id % 11 = 3 THEN 'overallVerdict' END", "CASE WHEN id % 6 = 4 THEN 'actionPlan' END",
    "CASE WHEN id % 8 = 5 THEN 'expectedResults.day60' END"])
_PRICE_IN = "CASE model WHEN 'gemini-2.5-flash' THEN 0.15::DOUBLE ELSE 1.25::DOUBLE END"
_PRICE_OUT = "CASE model WHEN 'gemini-2.5-flash' THEN 0.60::DOUBLE ELSE 10.0::DOUBLE END"
USAGE = f"""
us AS (SELECT conv_id AS scan_id, CASE role WHEN 'user' THEN 'gemini-2.5-flash' WHEN 'assistant' THEN 'gemini-2.5-pro'
         ELSE 'other-model' END AS model, turn % 3 <> 0 AND length(text) > 0 AS known, length(text) AS n FROM conversations),
ut AS (SELECT scan_id, model, CASE WHEN known THEN n * 10 ELSE round(n / 4.0::DOUBLE) END::BIGINT AS tin,
         CASE WHEN known THEN n ELSE 4000 END::BIGINT AS tout FROM us),
uc AS (SELECT *, tin / 1000000.0::DOUBLE * ({_PRICE_IN}) + tout / 1000000.0::DOUBLE * ({_PRICE_OUT}) AS cost FROM ut)
"""

# What the shops' sitemap files list, stated by the rule of the shop; no file is built or read here.
MAPS = """
md AS (SELECT id, k, id // 7 // 3 AS j, site, url FROM rf WHERE k <> 5),
mu AS (SELECT DISTINCT site, k, url FROM md WHERE k <> 6
       UNION SELECT DISTINCT site, k, 'https://' || site || '/fresh/' || id FROM md WHERE k <> 6 AND id % 10 = 0
       UNION SELECT DISTINCT site, k, 'https://' || site || '/maps/leaf-' || j FROM md WHERE k = 6),
ml AS (SELECT k, '2024-01-' || lpad(((min(j) FILTER (j % 4 = 1)) % 28 + 1)::VARCHAR, 2, '0') AS lastmod FROM md WHERE k <> 6 GROUP BY k),
ms AS (SELECT mu.*, lastmod, 'https://' || site || CASE k WHEN 0 THEN '/maps/root.xml' WHEN 2 THEN '/sitemap_index.xml'
         WHEN 3 THEN '/maps/second.xml' WHEN 4 THEN '/wp-sitemap.xml' ELSE '/sitemap.xml' END AS candidate,
         CASE k WHEN 0 THEN 0 WHEN 3 THEN 1 WHEN 2 THEN 1000001 WHEN 4 THEN 1000003 ELSE 1000000 END::BIGINT AS rank,
         CASE k WHEN 4 THEN 301 ELSE 200 END::BIGINT AS status
       FROM mu LEFT JOIN ml USING (k)),
mf AS (SELECT site, candidate, status, lastmod, count(*) AS n FROM ms GROUP BY ALL),
mr AS (SELECT DISTINCT site, k, k <> 5 AS found FROM rf WHERE k <> 1)
"""
_WITH_MAPS = (FACTS.replace("10 - 3 - 2 - least", "10 - 3 * (1 - sm) - 2 * (1 - rb) - least").replace("10 - 2 - 2 * (ok_no_bc", "10 - 2 * (1 - sm) - 2 * (ok_no_bc")
              .replace("FROM (SELECT DISTINCT site, url, path FROM rf)", "FROM (SELECT DISTINCT site, url, path FROM rf UNION SELECT site, url, '/x' FROM mu ANTI JOIN rf USING (site, url))")
              .replace("any_value(k) AS k\n", "any_value(k) AS k, (any_value(k) <> 5)::INT AS sm, (any_value(k) NOT IN (1, 5))::INT AS rb\n"))

# Response files, stated by the rule of the block of 25 documents that a response comes from.
LANDED = """
rs AS (SELECT *, b * 5 + row_number() OVER (PARTITION BY k, b ORDER BY id) AS at
       FROM (SELECT DISTINCT doc_id AS id, doc_id % 5 AS k, doc_id // 25 AS b FROM documents)),
rb AS (SELECT k, b, sum(id)::BIGINT AS links, count(*) AS n FROM rs GROUP BY 1, 2),
rg AS (SELECT * FROM rs WHERE b % 6 < 3)
"""
_VOLUME_OF = "CASE WHEN id % 4 <> 0 THEN id * 3 % 1000 END::BIGINT AS search_volume"
_DOMAIN = r"(?:https?://)?(?:www\.)?([a-zA-Z0-9-]+\.[a-zA-Z]{2,}(?:\.[a-zA-Z]{2})?)"
NOTES = r"""
gt AS (SELECT doc_id AS scan_id, string_split('See https://www.site' || doc_id % 9 || '.example.com/page and Shop' || doc_id % 4 || '.co.th'
         || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '  again site0.example and www.google.com ' || chr(10) ELSE chr(10) || chr(10) END
         || 'About Topic ' || doc_id % 6 || ' and own.example' || chr(10) || text, chr(10)) AS lines,
         ['topic 1', 'TOPIC ' || doc_id % 6, 'site', 'none such', 'x', 'y', 'z'] AS kws FROM documents),
gl AS (SELECT scan_id, unnest(lines) AS line, unnest(range(len(lines))) AS ln FROM gt)
"""
_TRIMMED = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"

_BOUNDS = ", ".join(["CASE WHEN id % 9 = 4 THEN 'oneSentenceTruth' END", "CASE WHEN id % 5 IN (0, 4) THEN 'topProblems' END",
    "CASE WHEN id % 3 = 1 AND id % 4 = 0 THEN 'rewriteBrief' END", "CASE WHEN id % 5 IN (0, 4) THEN 'titleOptions' END",
    "CASE WHEN id % 7 IN (0, 6) THEN 'faqSuggestions' END"])
_ANSWERS = f"""an AS (SELECT doc_id AS id, doc_id % 4 <> 3 AS parsed, list_filter([{_BOUNDS.replace('id %', 'doc_id %')}], lambda s: s IS NOT NULL) AS bad,
  CASE WHEN doc_id % 3 = 1 THEN ['line ' || i for i in range(1, 6 + doc_id % 4)] ELSE ['b' || i for i in range(1, 7)] END AS brief FROM documents)"""
_RISKY = "regexp_matches(text, '(?i)cloaking|doorway page|link spam|fake click|fake traffic|hidden text|keyword stuff|scrape google|bypass robots|fake review')"

SQL = {
    "keyword_ideas": f"""WITH {LANDED} SELECT 'site' || k AS target, "at", CASE WHEN id % 11 <> 0 THEN 'topic ' || id ELSE '' END AS keyword, {_VOLUME_OF},
        CASE WHEN id % 6 = 1 THEN '2024/1/' || id || '|2024/2/?' ELSE '' END AS monthly_trend, CASE WHEN id % 5 <> 0 THEN id % 7 / 2::DOUBLE END AS cpc,
        CASE WHEN id % 3 = 1 THEN 0.5::DOUBLE END AS competition, CASE WHEN id % 3 <> 0 THEN (id % 101)::DOUBLE END AS keyword_difficulty,
        CASE WHEN id % 2 = 0 THEN 'informational' ELSE 'unknown' END AS intent FROM rg""",
    "search_volumes": f"""WITH {LANDED} SELECT 'site' || k AS target, "at", 'topic ' || id AS keyword, {_VOLUME_OF},
        CASE WHEN id % 6 = 1 THEN '2024/3/' || id ELSE '' END AS monthly_trend, id % 7 / 2::DOUBLE AS cpc, NULL::DOUBLE AS competition,
        NULL::DOUBLE AS keyword_difficulty, 'unknown' AS intent FROM rg""",
    "backlinks": f"""WITH {LANDED} SELECT 'site' || k AS target, links AS total_backlinks, n AS referring_domains, 0::BIGINT AS lost_backlinks,
        links % 100 AS domain_rank FROM rb WHERE b % 6 < 3 AND n > 1""",
    "failed_responses": f"""WITH {LANDED}, x AS (SELECT k, b, unnest(['ideas', 'volumes', 'backlinks']) AS api FROM rb WHERE b % 6 >= 3)
        SELECT CASE WHEN b % 6 <> 4 THEN 'site' || k END AS target, CASE WHEN b % 6 <> 4 THEN api END AS api, CASE WHEN b % 6 <> 4 THEN b * 5 END AS "offset",
        CASE b % 6 WHEN 3 THEN 'refused' WHEN 4 THEN 'unreadable' ELSE 'no task' END AS reason,
        CASE WHEN b % 6 = 3 THEN 'Error: limit reached' END AS message, count(*) AS n FROM x GROUP BY ALL""",
    "domains_in_text": f"""WITH {NOTES}, dm AS (SELECT scan_id, ln, line, unnest(ds) AS domain, unnest(range(len(ds))) AS dn
          FROM (SELECT *, [lower(d) for d in regexp_extract_all(line, {q(_DOMAIN)}, 1)] AS ds FROM gl)),
        fd AS (SELECT * FROM dm WHERE domain <> 'own.example' AND NOT regexp_matches(domain, 'google|facebook|wikipedia')
               QUALIFY row_number() OVER (PARTITION BY scan_id, domain ORDER BY ln, dn) = 1)
        SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY ln, dn) - 1 AS at, domain,
          upper(domain[1]) || substr(split_part(domain, '.', 1), 2) AS name, {_TRIMMED.format('line')} AS snippet FROM fd""",
    "keyword_lines": f"""WITH {NOTES}, kw AS (SELECT scan_id, lines, unnest(kws) AS keyword, unnest(range(len(kws))) AS i FROM gt),
        kl AS (SELECT scan_id, i, keyword, coalesce(nullif({_TRIMMED.format("list_extract(list_filter(lines, lambda s: contains(lower(s), lower(keyword))), 1)")}, ''),
                 {_TRIMMED.format('list_extract(lines, i + 1)')}, '') AS serp_context FROM kw)
        SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY i) - 1 AS at, keyword, serp_context FROM kl WHERE serp_context <> ''""",
    "merged_sources": """WITH s AS (SELECT doc_id AS scan_id, list_concat(['u' || doc_id % 5, 'a', 'u' || doc_id % 3],
          ['u' || (i * doc_id) % 14 for i in range(1, 13)]) AS l FROM documents),
        u AS (SELECT scan_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM s), f AS (SELECT scan_id, x, min(i) AS i FROM u GROUP BY 1, 2)
        SELECT scan_id, string_agg(x, '|' ORDER BY i) AS sources FROM f GROUP BY 1""",
    "sitemap_urls": rich(MAPS, "SELECT site, candidate, rank, status AS candidate_status, lastmod, url FROM ms"),
    "site_sitemaps": rich(MAPS, "SELECT site, true AS sitemap_found, candidate AS sitemap_url, status AS sitemap_status, n AS sitemap_url_count, lastmod AS sitemap_lastmod FROM mf"),
    "robots_facts": rich(MAPS, """SELECT site, found AS robots_found, CASE WHEN found THEN 200 ELSE 404 END::BIGINT AS robots_status,
        CASE WHEN k = 0 THEN 'User-agent: *\nDisallow: /cart \nDisallow:\nSitemap: https://shop0.example.com/maps/root.xml\n'
             WHEN k = 3 THEN 'sitemap: https://shop3.example.com/maps/empty.xml\nSITEMAP: https://shop3.example.com/maps/second.xml\ndisallow: /x'
             WHEN found THEN 'User-agent: *\nDisallow: /shop' || k END AS robots_content,
        k IN (0, 3) AS sitemap_declared, CASE WHEN k = 0 THEN '/cart' WHEN k = 3 THEN '/x' WHEN found THEN '/shop' || k ELSE '' END AS disallowed_paths FROM mr"""),
    "audit_with_sitemaps": rich(MAPS, _WITH_MAPS, f"""SELECT sc.site, technical::BIGINT AS technical, onpage::BIGINT AS onpage,
        site_structure::BIGINT AS site_structure, ux_ui::BIGINT AS ux_ui, content_quality::BIGINT AS content_quality, {OVERALL} AS overall,
        sm = 1 AS sitemap_found, candidate AS sitemap_url, coalesce(mf.n, 0) AS sitemap_url_count, rb = 1 AS robots_found, k IN (0, 3) AS sitemap_declared,
        n_disc AS n_discovered, deep AS n_deep, CASE WHEN sm = 0 OR rb = 0 THEN f.n END AS affected_count
        FROM sc JOIN f USING (site) LEFT JOIN mf USING (site)"""),
    "discovered_with_sitemaps": rich(MAPS, "SELECT site, url FROM rf UNION SELECT site, url FROM mu"),
    "markup_head": rich("""SELECT page_id, site, page_type, title, meta_description, meta_robots, canonical, viewport,
        has_og_title, has_og_image, has_og_description, n_hreflang::BIGINT AS n_hreflang,
        meta_robots IS NOT NULL AS is_noindex, meta_robots IS NOT NULL AS is_nofollow,
        canonical IS NULL OR canonical = url AS canonical_is_self,
        coalesce(canonical LIKE '%other.example.net%', false) AS canonical_mismatch,
        CASE WHEN got THEN '#336699|#abcdef' ELSE '' END AS brand_colors FROM rf"""),
    "markup_schema": rich("""SELECT page_id, CASE WHEN NOT got THEN '' ELSE CASE id % 12
        WHEN 0 THEN 'Organization|WebSite|BreadcrumbList' WHEN 1 THEN 'Product,Thing' WHEN 2 THEN 'FAQPage'
        WHEN 3 THEN 'BlogPosting' WHEN 5 THEN 'Place|City|Event|Map' ELSE '' END END AS schema_types, has_org AS has_organization_schema,
        has_product AS has_product_schema, has_faq_schema, has_breadcrumb AS has_breadcrumb_schema,
        has_article AS has_article_schema, has_org AS has_website_schema FROM rf"""),
    "markup_body": rich("""SELECT page_id, h1, h1_count::BIGINT AS h1_count,
        CASE WHEN got THEN array_to_string(['Part ' || j for j in range(1, id % 4 + 1)], '|') ELSE '' END AS h2s,
        CASE WHEN got THEN array_to_string(['Step ' || j for j in range(1, id % 3 + 1)], '|') ELSE '' END AS h3s,
        h1_count > 1 AS has_multiple_h1, h1_count = 1 AND (h2_count > 0 OR h3_count = 0) AS heading_hierarchy_ok,
        image_count::BIGINT AS image_count, missing_alt_count::BIGINT AS missing_alt_count,
        (image_count - missing_alt_count)::BIGINT AS images_with_alt, has_table, has_numbered_list, has_cta_button,
        has_faq, has_toc AS has_table_of_contents, has_author, has_date, has_contact_info,
        word_count::BIGINT AS word_count, (CASE WHEN got THEN 1 ELSE 0 END)::BIGINT AS paragraph_count,
        CASE WHEN got THEN substr(content, 1, 2000) ELSE '' END AS body_snippet FROM rf"""),
    "markup_links": rich("""SELECT page_id, internal_link_count::BIGINT AS internal_link_count,
        external_nofollow_count::BIGINT AS external_nofollow_count, 0::BIGINT AS external_dofollow_count,
        CASE WHEN got THEN 'Home|Item ' || k || CASE k WHEN 3 THEN '|RAW_NAME' WHEN 5 THEN '|{menu}' ELSE '' END ELSE '' END AS nav_items,
        CASE WHEN got THEN CASE k WHEN 3 THEN 'RAW_NAME' WHEN 5 THEN '{menu}' ELSE '' END ELSE '' END AS broken_nav_items FROM rf"""),
    "markup_site_scores": rich(FACTS, f"""SELECT site, technical::BIGINT AS technical, onpage::BIGINT AS onpage,
        site_structure::BIGINT AS site_structure, ux_ui::BIGINT AS ux_ui, content_quality::BIGINT AS content_quality,
        {OVERALL} AS overall FROM sc"""),
    "markup_site_issues": rich(FACTS, ISSUES),
    "markup_issue_evidence": rich(FACTS, EVIDENCE, "SELECT * FROM ev"),
    "markup_schema_summary": rich(FACTS, """SELECT f.site, array_to_string(list_filter([
          CASE WHEN NOT home_org THEN 'Homepage' END, CASE WHEN NOT prod_schema THEN 'Product pages' END,
          CASE WHEN NOT faq_schema THEN 'FAQ page' END, '*'], lambda s: s IS NOT NULL), '|') AS pages
        FROM f JOIN fp USING (site) WHERE no_schema > n * 0.4::DOUBLE"""),
    "markup_strengths": rich(FACTS, """SELECT site, unnest(list_filter([{'id': 'https', 'd': NULL},
          {'id': 'languages', 'd': 'en, th'},
          CASE WHEN n_ok - ok_no_schema > n_ok * 0.3::DOUBLE THEN {'id': 'schema', 'd': (n_ok - ok_no_schema)::VARCHAR} END,
          CASE WHEN ok_faq > 0 THEN {'id': 'faq', 'd': NULL} END,
          CASE WHEN n_ok - ok_no_meta > n_ok * 0.7::DOUBLE THEN {'id': 'meta_descriptions', 'd': (n_ok - ok_no_meta)::VARCHAR} END,
          CASE WHEN ok_prod > 5 THEN {'id': 'products', 'd': ok_prod::VARCHAR} END,
          CASE WHEN ok_cat > 3 THEN {'id': 'collections', 'd': ok_cat::VARCHAR} END,
          CASE WHEN ok_contact > n_ok * 0.5::DOUBLE THEN {'id': 'contact_info', 'd': NULL} END], lambda s: s IS NOT NULL)) AS s
        FROM f""").replace("SELECT site, unnest", "SELECT site, s.id AS id, s.d AS detail FROM (SELECT site, unnest", 1) + ")",
    "markup_recommended_sitemap": rich(SITEMAP, f"""SELECT site, {_bucket('collections')}, {_bucket('pages')},
        {_bucket('blogs')}, {_bucket('other')} FROM al GROUP BY site"""),
    "markup_schema_coverage": rich("""SELECT site, count(*) FILTER (n_schemas > 0) AS with_any_schema,
        count(*) FILTER (has_org) AS with_org, count(*) FILTER (has_product) AS with_product,
        count(*) FILTER (has_breadcrumb) AS with_breadcrumb, count(*) FILTER (has_faq_schema) AS with_faq,
        count(*) FILTER (has_article) AS with_article FROM rf WHERE status = 200 GROUP BY site"""),
    "markup_type_counts": rich("SELECT site, " + ", ".join(
        f"count(*) FILTER (page_type = {q('category' if t == 'collection' else t)}) AS {t}"
        for t in ("home", "product", "collection", "blog", "service", "faq", "about", "contact", "policy", "other"))
        + " FROM rf WHERE status = 200 GROUP BY site"),
    "markup_languages": rich("SELECT DISTINCT site, unnest(['en', 'th']) AS lang FROM rf WHERE n_hreflang > 0"),
    "markup_markets": rich("SELECT DISTINCT site, 'Thailand/Thai|Thailand/English' AS markets FROM rf WHERE n_hreflang > 0"),
    "markup_crawl_queue": rich("""SELECT DISTINCT site, unnest(list_concat(['https://' || host || '/', 'https://' || host || '/items'],
          CASE k WHEN 3 THEN ['https://' || host || '/raw'] WHEN 5 THEN ['https://' || host || '/menu'] ELSE [] END,
          ['https://' || host || '/products/p' || j for j in range(1, id % 5 + 1)],
          CASE WHEN id % 8 = 3 THEN ['https://' || host || '/buy'] ELSE [] END)) AS url
        FROM rf WHERE page_type = 'home'"""),
    "markup_broken_pages": rich("SELECT page_id, site FROM rf WHERE status >= 400"),
    "ranked_keyword_rows": "WITH " + PAGES + "," + TOKEN_TABLE + """SELECT site AS target, position AS at, keyword,
        CASE WHEN position % 7 <> 0 THEN position END AS position, 'https://' || site || '/' || keyword AS url,
        search_volume, position * 2.0::DOUBLE AS keyword_difficulty,
        CASE WHEN position % 3 = 0 THEN 'commercial' ELSE 'unknown' END AS intent,
        CASE WHEN position % 7 = 0 THEN 'Low' WHEN position <= 3 THEN 'High' WHEN position <= 10 THEN 'Medium' ELSE 'Low' END AS priority,
        CASE WHEN position % 7 = 0 THEN 'create' WHEN position <= 3 THEN 'protect'
             WHEN position <= 10 THEN 'improve' WHEN position <= 20 THEN 'refresh'
             ELSE 'support' END AS suggested_action,
        CASE WHEN position * 2 >= 70 THEN 'high' WHEN position * 2 >= 40 THEN 'medium' ELSE 'low' END AS difficulty_band
        FROM ranked""",
    "keyword_tables": "WITH " + PAGES + "," + TOKEN_TABLE + f"SELECT site AS target, rank, keyword, search_volume FROM ({top_k('ranked', 'site', 'search_volume DESC, keyword', 25)})",
    "competitor_report": "WITH " + PAGES + "," + TOKEN_TABLE + """,
        ow AS (SELECT site, lower(keyword) AS key FROM ranked WHERE position % 7 <> 0 GROUP BY 1, 2),
        tk AS (SELECT p.site, p.competitor, r.keyword, r.search_volume, o.key IS NULL AS gap FROM pairs p
               JOIN ranked r ON r.site = p.competitor LEFT JOIN ow o ON o.site = p.site AND o.key = lower(r.keyword)),
        gp AS (SELECT *, row_number() OVER (PARTITION BY site, competitor ORDER BY search_volume DESC, keyword) AS g FROM tk WHERE gap),
        gl AS (SELECT site, competitor, count(*) AS n_gaps, array_to_string((list(keyword ORDER BY g))[1:10], '|') AS l FROM gp GROUP BY 1, 2),
        kn AS (SELECT site, competitor, count(*) AS n_keywords FROM tk GROUP BY 1, 2)
        SELECT p.site AS target, rank, p.competitor AS domain,
          least(100, round(shared_keywords / (shared_keywords + missing_keywords)::DOUBLE * 100))::BIGINT AS estimated_visibility,
          shared_keywords, missing_keywords,
          CASE WHEN coalesce(n_gaps, 0) > 5 THEN 'fill_gaps' ELSE 'watch' END AS suggested_action,
          n_keywords, coalesce(n_gaps, 0) AS n_gaps, least(n_keywords, 20) AS n_listed, coalesce(l, '') AS keyword_gaps
        FROM pairs p LEFT JOIN gl ON gl.site = p.site AND gl.competitor = p.competitor
          JOIN kn ON kn.site = p.site AND kn.competitor = p.competitor""",
    "model_costs": f"WITH {USAGE} SELECT scan_id, model, sum(tin)::BIGINT AS input_tokens, sum(tout)::BIGINT AS output_tokens, "
                   "round(sum(cost), 9) AS cost_usd FROM uc GROUP BY 1, 2",
    "api_costs": "SELECT user_id AS scan_id, event_type AS api, round(sum(value), 4) AS cost_usd, count(*) AS n_calls FROM events GROUP BY 1, 2",
    "scan_costs": f"""WITH {USAGE}, m AS (SELECT scan_id, sum(tin)::BIGINT AS tin, sum(tout)::BIGINT AS tout, sum(cost) AS c FROM uc GROUP BY 1),
        a AS (SELECT user_id AS scan_id, sum(value) AS v FROM events GROUP BY 1)
        SELECT coalesce(m.scan_id, a.scan_id) AS scan_id, coalesce(tin, 0) AS input_tokens, coalesce(tout, 0) AS output_tokens,
          round(coalesce(c, 0) + coalesce(v, 0), 4) AS total_cost_usd, round((coalesce(c, 0) + coalesce(v, 0)) * 34, 2) AS total_cost_thb
        FROM m FULL JOIN a ON m.scan_id = a.scan_id""",
    "answer_visibility": """SELECT site, CASE WHEN b::DOUBLE / n < 0.3::DOUBLE THEN 'Low' WHEN b::DOUBLE / n < 0.6::DOUBLE THEN 'Medium' ELSE 'High' END AS brand_mention_status,
        'Medium' AS competitor_mentions, g AS citation_source_gaps, n - b AS prompt_opportunities,
        round(n * 0.75::DOUBLE)::BIGINT AS faq_opportunities, least(100, 40 + b * 8) AS entity_clarity_score
        FROM (SELECT user_id::VARCHAR AS site, count(*) AS n, count(*) FILTER (event_type IN ('purchase', 'click') AND user_id % 3 > 0
          OR event_type = 'view' AND user_id % 3 = 2) AS b, count(*) FILTER (value > 20) AS g FROM events GROUP BY 1)""",
    "site_answers": f"""SELECT id AS scan_id, id % 4 <> 3 AS is_parsed,
        CASE WHEN id % 4 <> 3 THEN array_to_string(list_filter([{_MISSING}], lambda s: s IS NOT NULL), '|') END AS missing,
        id % 4 <> 3 AND len(list_filter([{_MISSING}], lambda s: s IS NOT NULL)) = 0 AS is_accepted,
        CASE WHEN id % 4 <> 3 THEN 1 END::BIGINT AS n_gaps, CASE WHEN id % 4 <> 3 THEN 0 END::BIGINT AS n_quick_wins
        FROM (SELECT doc_id AS id FROM documents)""",
    "rejected_answers": f"""SELECT id AS scan_id, CASE WHEN id % 4 = 3 THEN 'broken_json' ELSE 'missing_fields' END AS reason,
        CASE WHEN id % 4 <> 3 THEN array_to_string(list_filter([{_MISSING}], lambda s: s IS NOT NULL), '|') END AS missing
        FROM (SELECT doc_id AS id FROM documents) WHERE id % 4 = 3 OR len(list_filter([{_MISSING}], lambda s: s IS NOT NULL)) > 0""",
    "article_answers": f"""WITH {_ANSWERS} SELECT id AS scan_id, parsed AS is_parsed, CASE WHEN parsed THEN array_to_string(bad, '|') END AS out_of_bounds,
        parsed AND len(bad) = 0 AS is_accepted, CASE WHEN parsed THEN array_to_string(brief, '|') END AS brief FROM an""",
    "merged_scans": f"""WITH {_ANSWERS} SELECT id AS scan_id, CASE WHEN ok THEN array_to_string(['p' || i for i in range(1, 3 + id % 5)], '|') ELSE 'rule' END AS top_problems,
        CASE WHEN ok THEN array_to_string(['• ' || b for b in brief], chr(10)) ELSE 'rule brief' END AS rewrite_brief, ok AS is_ai_enhanced
        FROM (SELECT *, parsed AND len(bad) = 0 AS ok FROM an)""",
    "risky_inputs": f"""SELECT conv_id, turn, role, NOT ((conv_id + turn) % 5 = 0 OR {_RISKY}) AS is_safe FROM conversations""",
    "rejected_inputs": f"""SELECT conv_id, turn, role FROM conversations WHERE (conv_id + turn) % 5 = 0 OR {_RISKY}""",
    "value_bands": """SELECT doc_id, CASE WHEN v >= 70 THEN 'high' WHEN v >= 40 THEN 'medium' WHEN v >= 0 THEN 'low' ELSE 'unknown' END AS difficulty,
        CASE WHEN v >= 60 THEN 'high' WHEN v >= 30 THEN 'medium' WHEN v >= 0 THEN 'low' ELSE 'unknown' END AS authority,
        CASE WHEN v >= 60 THEN 'high' WHEN v >= 30 THEN 'medium' WHEN v >= 0 THEN 'low' ELSE 'unknown' END AS visibility,
        CASE WHEN v >= 70 THEN 'high' WHEN v >= 40 THEN 'medium' WHEN v >= 0 THEN 'low' ELSE 'unknown' END AS clarity,
        CASE WHEN v % 25 <= 3 THEN 'top3' WHEN v % 25 <= 10 THEN 'top10' WHEN v % 25 <= 20 THEN 'top20' WHEN v IS NULL THEN 'unknown' ELSE 'beyond' END AS position
        FROM (SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN doc_id % 101 END AS v FROM documents)""",
    "issue_insights": rich(FACTS, f"""SELECT site, issue_id, CASE WHEN rule_no % 3 = 0 THEN 'model|' || site ELSE 'rule ' || issue_id END AS impact,
        CASE WHEN rule_no % 6 = 0 THEN 'model fix' ELSE 'own fix' END AS fix FROM ({ISSUES})"""),
    "markup_evidence_chips": rich(FACTS, EVIDENCE, """SELECT site, issue_id, "at",
        substr(coalesce(nullif(url, ''), nullif(page, ''), nullif(label, ''), nullif(note, ''), ''), 1, 60) AS label,
        substr(coalesce(nullif(current, ''), CASE WHEN status <> 0 THEN 'status: ' || status END, CASE WHEN value <> '0' THEN nullif(value, '') END, ''), 1, 40) AS detail
        FROM ev WHERE "at" < 4"""),
    "error_classes": """SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'quota' WHEN 1 THEN 'model_missing'
        WHEN 2 THEN 'permission_denied' WHEN 3 THEN 'authentication_failed' WHEN 4 THEN 'impersonation_denied'
        ELSE 'other' END AS error_class, turn % 6 IN (0, 1, 5) AS is_retryable FROM conversations""",
    "pasted_inputs": f"""SELECT page_id AS input_id, regexp_replace(url, '[.,;:!?)]+$', '') AS main_url,
        CASE WHEN page_id % 2 = 0 THEN 'https://maps.example.org/sitemap.xml' END AS sitemap_url,
        'https://rival.example.org/a-' || page_id || '|https://second.example.net/b' AS competitor_urls,
        CASE WHEN page_id % 3 = 0 THEN 'topic ' || page_id END AS detected_keyword,
        (70 + CASE WHEN page_id % 3 = 0 THEN 15 ELSE 0 END)::BIGINT AS confidence FROM pages""",
}
