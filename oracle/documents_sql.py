"""DuckDB twins of the queries over documents and conversations."""

from oracle.base import collapse, decode, pages, q, strip_tags, text_of
from sitewright import fixed_values as fv

_URL = r"""(?i)https?://[^\s<>"{}|\\^`\[\]]+"""
_HTML = r"(?i)<\s*(?:html|head|body|article|div|h[1-6]|p|section)(?:[^A-Za-z0-9_]|$)"
_KEYWORD = r"(?i)(?:keywords?|คีย์เวิร์ด)\s*:\s*([^\n]+)"
_TRIM = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"


def any_word(words) -> str:
    """Case-insensitive alternation of words that have no special characters."""
    return "(?i)" + "|".join(words)


def first_case(x: str, types) -> str:
    return "(CASE " + " ".join(
        f"WHEN regexp_matches({x}, {q(any_word(words))}) THEN {q(n)}" for n, words in types
    ) + " ELSE 'General' END)"


_SPACED = "'  ' || regexp_replace(body, '[^A-Za-z0-9_]+', '  ', 'g') || '  '"
_OVERCLAIMS = "[" + ", ".join(
    f"CASE WHEN regexp_matches(body, {q('(?i)' + '.*'.join(p))}) THEN {q(n)} END" for n, p in fv.OVERCLAIMS) + "]"
_CTA = "[" + ", ".join(
    f"CASE WHEN contains(lower(body), {q(p)}) THEN {q(p)} END" for p in fv.CTA_PHRASES) + "]"

# What follows from the text of a body, for documents and for marked-up articles alike.
BODY = rf"""len(regexp_extract_all(body, '[^ ]+')) AS wc,
    regexp_matches(body, {q(any_word(fv.ARTICLE_FAQ_WORDS))}) AS faq,
    regexp_matches(body, '(?:^|[^A-Za-z0-9_])[0-9]{{3}}[-.]?[0-9]{{3}}[-.]?[0-9]{{4}}(?:$|[^A-Za-z0-9_])|0[689][0-9]{{8}}') AS phone,
    regexp_matches(body, '[A-Za-z0-9_][.%+-]*@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}(?:$|[^A-Za-z0-9_])') AS email,
    regexp_matches(body, {q('(?i)line|ไลน์|@[a-z0-9_]+')}) AS line,
    list_filter({_CTA}, lambda x: x IS NOT NULL) AS cta,
    list_filter({_OVERCLAIMS}, lambda x: x IS NOT NULL) AS claims,
    regexp_extract_all({_SPACED}, ' (201[0-9]|202[0-2]) ', 1) AS years,
    [trim(s) for s in regexp_extract_all(body, '[^.!?]*\?') if length(trim(s)) between 11 and 199] AS asked,
    array_to_string(string_split(body, ' ')[:300], ' ') AS head,"""

DOCS = rf"""
d0 AS (
  SELECT doc_id AS article_id, text, {_TRIM} AS t FROM documents),
d1 AS (
  SELECT *, list_distinct([regexp_replace(u, '[.,;:!?)]+$', '') for u in
      regexp_extract_all(t, {q(_URL)})]) AS urls,
    trim(regexp_replace(t, {q(_URL)}, '', 'g'), chr(32) || chr(9) || chr(10) || chr(13)) AS bare,
    regexp_matches(t, {q(_HTML)}) AS has_html,
    nullif(trim(regexp_extract(t, {q(_KEYWORD)}, 1)), '') AS keyword,
    length(regexp_replace(t, '[^฀-๿]', '', 'g')) AS thai,
    length(regexp_replace(t, '[^a-zA-Z]', '', 'g')) AS latin
  FROM d0),
d2 AS (
  SELECT *, list_extract([u for u in urls if not contains(lower(u), 'sitemap')], 1) AS main_url,
    CASE WHEN NOT has_html AND length(bare) > 150 THEN bare END AS raw_text,
    CASE WHEN thai > 0 AND latin > 0
           THEN CASE WHEN thai > latin * 0.5 THEN 'Thai/English mixed' ELSE 'English' END
         WHEN thai > 10 THEN 'Thai' WHEN latin > 10 THEN 'English' ELSE 'Unknown' END AS language
  FROM d1),
d3 AS (
  SELECT *, {text_of('coalesce(CASE WHEN has_html THEN t END, raw_text)')} AS body,
    {first_case("t || coalesce(main_url, '')", fv.ARTICLE_TYPE_WORDS)} AS first_type
  FROM d2),
da AS (
  SELECT *, body IS NOT NULL AS has_article,
    {BODY}
    CASE WHEN first_type = 'General' AND body IS NOT NULL
      THEN {first_case("lower(body)", fv.ARTICLE_TYPE_UPGRADE_WORDS)}
      ELSE first_type END AS kind
  FROM d3)
"""

COMPETITORS = r"""
tgt AS (SELECT article_id, unnest([1, 2, 3, 4]) AS pos FROM da),
cmp AS (SELECT tgt.article_id, tgt.article_id + tgt.pos AS competitor_id, pos, c.has_article IS TRUE AS fetched,
               coalesce(c.wc, 0) AS their, coalesce(c.faq, false) AS their_faq
        FROM tgt LEFT JOIN da c ON c.article_id = tgt.article_id + tgt.pos),
avgs AS (SELECT article_id, count(*) AS n_comp, avg(their)::DOUBLE AS mean_words,
                count(*) FILTER (their_faq) AS n_faq FROM cmp GROUP BY article_id),
x AS (SELECT da.*, n_comp, mean_words, n_faq, 0 AS n_tab, coalesce(wc, 0) AS w,
             coalesce(faq, false) AS f, kind IN ('Visa', 'Travel') AS vt,
             mean_words > 0 AND coalesce(wc, 0) < mean_words * 0.6::DOUBLE AS far,
             NULL::VARCHAR AS title, NULL::VARCHAR AS h1, NULL::VARCHAR AS meta, NULL::VARCHAR AS robots, false AS elsewhere,
             0 AS n_schema, false AS faq_schema, 0 AS no_alt, NULL::VARCHAR AS og, CASE WHEN has_article THEN 0 END AS tables, 0 AS h2n,
             []::VARCHAR[] AS h2s, 0 AS lists, false AS author, false AS dated, 0 AS official, 0 AS links, 0 AS weak,
             coalesce(phone OR email OR line, false) AS contact
      FROM da JOIN avgs USING (article_id))
"""


#: The same without any rival, as reports are written of single articles.
NO_RIVALS = COMPETITORS.replace("avgs AS (SELECT article_id, count(*) AS n_comp, avg(their)::DOUBLE AS mean_words,", "avgs AS (SELECT article_id, 0 AS n_comp, 0::DOUBLE AS mean_words,").replace(
    "count(*) FILTER (their_faq) AS n_faq", "0 AS n_faq")
_T, _H, _K = "lower(coalesce(title, ''))", "lower(coalesce(h1, ''))", "lower(coalesce(keyword, ''))"
_YEARS = "'old_years=' || array_to_string([y for y, i in years if list_position(years, y) = i], ', ')"
# (category, maximum, cut-offs, rules); a rule is (condition, points off or None for none left, evidence)
CATEGORIES = (
    ("crawl", 7, (6, 4, 2), [
        (f"{_T} = ''", 3, "'no_title'"), (f"{_H} = ''", 2, "'no_h1'"), ("contains(coalesce(robots, ''), 'noindex')", None, "'noindex'"),
        ("elsewhere", 2, "'canonical_elsewhere'")]),
    ("technical", 7, (6, 4, 2), [
        ("coalesce(meta, '') = ''", 2, "'no_meta_description'"), ("n_schema = 0", 2, "'no_schema'"),
        ("no_alt > 3", 1, "'images_without_alt=' || no_alt"), ("coalesce(og, '') = ''", 1, "'no_og_title'")]),
    ("intent", 12, (10, 7, 4), [
        (f"{_K} <> '' AND {_T} <> '' AND NOT contains({_T}, {_K}) AND NOT contains({_K}, split_part({_T}, ' ', 1))", 4, "'keyword_not_in_title'"),
        (f"{_K} <> '' AND {_H} <> '' AND NOT contains({_H}, {_K})", 3, "'keyword_not_in_h1'"), ("w < 300", 3, "'under_300_words'")]),
    ("depth", 12, (10, 7, 4), [
        ("w < 800", 4, "'words=' || w"), ("far", 3, "'rival_words=' || round(mean_words)::BIGINT"),
        ("coalesce(tables = 0, false)", 1, "'no_table'"), ("NOT f", 2, "'no_faq'"), ("h2n < 3", 2, "'few_h2'")]),
    ("competitors", 10, (8, 6, 4), [
        ("n_comp = 0", 5, "'no_rivals'"), ("n_faq > 0 AND NOT f", 3, "'rivals_have_faq'"), ("n_tab > 0 AND coalesce(tables, 0) = 0", 2, "'rivals_have_tables'")]),
    ("trust", 12, (10, 7, 4), [
        ("NOT author", 3, "'no_author'"), ("NOT dated", 2, "'no_date'"), ("official = 0 AND vt", 4, "'no_official_source'"),
        ("len(claims) > 0", 3, "'overclaims=' || array_to_string(claims, ', ')")]),
    ("internal_links", 9, (7, 5, 3), [
        ("links = 0", 5, "'no_internal_links'"), ("links BETWEEN 1 AND 2", 2, "'internal_links=' || links"), ("weak > 2", 2, "'weak_anchors'")]),
    ("snippet", 6, (5, 3, 2), [
        ("length(coalesce(title, '')) = 0", 3, "'no_title'"), ("length(coalesce(title, '')) > 60", 1, "'title_chars=' || length(title)"),
        ("length(coalesce(title, '')) BETWEEN 1 AND 19", 1, "'short_title'"), ("coalesce(meta, '') = ''", 2, "'no_meta_description'"),
        ("length(coalesce(meta, '')) > 160", 1, "'long_meta_description'")]),
    ("extractability", 8, (7, 5, 3), [
        ("NOT f", 2, "'no_faq'"), ("coalesce(tables = 0, false)", 1, "'no_table'"), ("coalesce(len(asked), 0) < 2", 2, "'few_questions'"),
        ("NOT contains(head, '?') AND length(head) > 100", 1, "'no_early_answer'")]),
    ("freshness", 5, (4, 3, 2), [("len(years) > 2", 2, _YEARS), ("NOT dated", 2, "'no_date'")]),
    ("conversion", 5, (4, 3, 2), [
        ("coalesce(len(cta), 0) = 0", 2, "'no_cta'"), ("kind = 'Local/Service' AND NOT contact", 3, "'service_without_contact'")]),
)


def _raw(most: int, rules) -> str:
    """Points after the rules in their order; a rule without points wipes out what stood before it."""
    last = max((i for i, (_, n, _) in enumerate(rules) if n is None), default=None)
    off = lambda some: " + ".join(["0"] + [f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n, _ in some])
    if last is None:
        return f"({most} - ({off(rules)}))"
    return f"(CASE WHEN {rules[last][0]} THEN 0 ELSE {most} - ({off(rules[:last])}) END - ({off(rules[last + 1:])}))"


def _score_rows() -> str:
    rows = []
    for i, (key, most, cuts, rules) in enumerate(CATEGORIES, 1):
        raw = _raw(most, rules)
        said = "[" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, _, t in rules) + "]"
        rows.append(
            f"SELECT article_id, {i}::BIGINT AS position, {q(key)} AS category, "
            f"greatest({raw}, 0)::BIGINT AS score, {most}::BIGINT AS max_score, "
            f"CASE WHEN {raw} >= {cuts[0]} THEN 'excellent' WHEN {raw} >= {cuts[1]} THEN 'good' "
            f"WHEN {raw} >= {cuts[2]} THEN 'warning' ELSE 'critical' END AS status, "
            f"array_to_string(list_filter({said}, lambda s: s IS NOT NULL), '|') AS evidence FROM x")
    rows.append("SELECT article_id, 12, 'cannibalization', 5, 5, 'good', 'needs_sitemap' FROM x")
    rows.append("SELECT article_id, 13, 'topical', 1, 2, 'warning', 'needs_site_analysis' FROM x")
    return " UNION ALL ".join(rows)


SCORES = f"sc AS ({_score_rows()}), tot AS (SELECT article_id, sum(score)::BIGINT AS total FROM sc GROUP BY 1)"
VERDICT = "(CASE " + " ".join(f"WHEN total >= {n} THEN {q(v)}" for n, v in fv.VERDICTS) + (
    f" ELSE {q(fv.LOWEST_VERDICT)} END)")

_FIRES = {
    "title": (f"{_T} = ''", "''"), "h1": (f"{_H} = ''", "''"), "thin": ("w BETWEEN 1 AND 799", "'words=' || w"),
    "faq": ("NOT f", "''"), "links": ("links = 0", "''"), "author": ("NOT author", "''"), "date": ("NOT dated", "''"),
    "sources": ("vt AND official = 0", "''"), "overclaim": ("coalesce(len(claims), 0) > 0", "array_to_string(claims, '|')"),
    "meta": ("coalesce(meta, '') = ''", "''"),
    "keyword": (f"{_K} <> '' AND {_T} <> '' AND NOT contains({_T}, split_part({_K}, ' ', 1))", "'title=' || title || '|keyword=' || keyword"),
    "tables": ("vt AND coalesce(tables = 0, false)", "''"), "structure": ("h2n < 3", "'h2s=' || h2n"),
    "competitor_faq": ("n_faq > 0 AND NOT f", "'rivals_with_faq=' || n_faq"),
    "competitor_depth": ("far", "'words=' || w || '|rival_words=' || round(mean_words)::BIGINT"),
}
_NEEDS = {"keyword": "'=' || keyword", "competitor_depth": "'=' || round(mean_words * 0.8::DOUBLE - w)::BIGINT"}
# key, type, confidence, impact, effort, priority, stated here once more on purpose
RULES = (
    ("title", "Missing Title Tag", 99, "high", "easy", 1), ("h1", "Missing H1", 99, "high", "easy", 1),
    ("thin", "Thin Content", 90, "high", "hard", 2), ("faq", "No FAQ Section", 85, "medium", "medium", 2),
    ("links", "No Internal Links", 95, "medium", "easy", 2), ("author", "Missing Author / E-E-A-T Signal", 80, "medium", "easy", 3),
    ("date", "No Publication/Update Date", 75, "medium", "easy", 3), ("sources", "No Official Sources for Visa/Travel", 90, "high", "medium", 1),
    ("overclaim", "Compliance Risk: Overclaim Language", 95, "high", "easy", 1), ("meta", "Missing Meta Description", 99, "medium", "easy", 2),
    ("keyword", "Keyword Missing from Title", 80, "high", "easy", 1), ("tables", "No Tables in Visa/Travel Content", 85, "medium", "medium", 2),
    ("structure", "Poor Content Structure", 90, "medium", "medium", 2), ("competitor_faq", "Competitor FAQ Gap", 85, "high", "medium", 1),
    ("competitor_depth", "Content Depth Far Below Competitors", 85, "high", "hard", 1),
)


def _failure_rows() -> str:
    rows = []
    for i, (key, kind, conf, impact, effort, prio) in enumerate(RULES, 1):
        fires, evidence = _FIRES[key]
        rows.append(
            f"SELECT article_id, {i} AS rule, {q(kind)} AS type, {conf}::BIGINT AS confidence, "
            f"{evidence} AS evidence, {q(impact)} AS impact, "
            f"'fix_{key}' || {_NEEDS.get(key, q(''))} AS fix, {q(effort)} AS effort, "
            f"{prio}::BIGINT AS priority FROM x WHERE {fires}")
    return " UNION ALL ".join(rows)


FAILURES = (f"fl0 AS ({_failure_rows()}), fl AS (SELECT *, row_number() OVER (PARTITION BY article_id "
            "ORDER BY priority, rule) AS rank FROM fl0), fa AS (SELECT article_id, count(*) AS n, "
            "count(*) FILTER (impact = 'high') AS high, bool_or(type = 'Thin Content') AS thin, "
            "array_to_string((list(type || CASE WHEN evidence = '' THEN '' ELSE ': ' || split_part(evidence, '|', 1) END ORDER BY rank))[:5], '|') AS problems, "
            "array_to_string((list(fix ORDER BY rank))[:5], '|') AS fixes, "
            "list_extract(list(type ORDER BY rank), 1) AS worst FROM fl GROUP BY article_id)")
DECISION = ("CASE WHEN thin AND w < 300 THEN 'Rebuild From Scratch' WHEN high >= 4 THEN 'Major Rewrite' "
            "WHEN n >= 6 THEN 'Major Rewrite' WHEN n >= 3 THEN 'Optimize' WHEN n = 0 THEN 'Keep' "
            "ELSE 'Minor Optimize' END")
_LIST = "array_to_string(list_filter({}, lambda s: s IS NOT NULL), '|')"


def docs(*parts: str) -> str:
    *ctes, select = parts
    return "WITH " + ", ".join([DOCS, *ctes]) + " " + select


SCANS = f"""sn AS (SELECT x.article_id::VARCHAR AS id, text AS raw_input,
  keyword AS detected_keyword, kind AS detected_article_type, language AS detected_language,
  total::DOUBLE AS score, {VERDICT} AS verdict, {DECISION} AS final_decision,
  DATE '2024-01-01' + (x.article_id % 90)::INT AS created_at
  FROM x JOIN tot USING (article_id) JOIN fa USING (article_id))"""
_LISTED = ("id, detected_keyword, detected_article_type, detected_language, score, verdict, "
           "final_decision, created_at")

_PIECES = ["h1", "array_to_string(['Part ' || j for j in range(1, id % 5 + 1)], ' ')",
    "CASE id % 9 WHEN 1 THEN 'Process and timeline' WHEN 2 THEN 'Mistakes to avoid' END", "CASE WHEN id % 13 = 5 THEN 'FAQ' END",
    "array_to_string(['Step ' || j for j in range(1, id % 3 + 1)], ' ')", "CASE WHEN id % 11 = 3 THEN 'Answers' END", "text",
    "array_to_string(['What is topic number ' || j || ' about?' for j in range(1, id % 3 + 1)], ' ')",
    "CASE WHEN id % 7 = 3 THEN 'In 2011 and 2012 and 2013 and 2012 it began.' END",
    "CASE id % 12 WHEN 3 THEN 'This is a 100% success story.' WHEN 9 THEN 'We guarantee every visa.' END",
    "CASE WHEN id % 4 = 3 THEN 'Contact us today.' END", "CASE WHEN id % 9 = 6 THEN 'Call 0812345678 now.' END",
    "CASE WHEN id % 4 = 2 THEN 'Cell' END", "CASE WHEN id % 5 = 3 THEN 'One Two' END", "CASE WHEN id % 4 = 1 THEN 'Ann ' || id END",
    "CASE id % 5 WHEN 2 THEN '1 March' WHEN 4 THEN 'May ' || id END", "array_to_string(['Page ' || j for j in range(1, id % 4 + 1)], ' ')",
    "CASE WHEN id % 8 = 7 THEN 'click here click here click here' END", "CASE WHEN id % 6 = 1 THEN 'Embassy' END", "CASE WHEN id % 6 = 2 THEN 'Partner' END"]
#: Marked-up articles, stated by their rule; no markup is written or read here.
ARTICLES = rf"""
m0 AS (SELECT doc_id AS id, doc_id AS article_id, text, doc_id % 5 AS k,
         CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Topic ' || id || ' explained' ELSE 'A general view' END AS h1,
         CASE id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'Tip ' || id WHEN 2 THEN 'A very long title about topic ' || id || ' that goes on for more than sixty characters'
           WHEN 3 THEN 'Topic overview' ELSE 'Guide to topic ' || id || ' for readers' END AS title,
         CASE WHEN id % 6 <> 0 THEN 'topic ' || id END AS keyword,
         CASE (id // 5) % 5 WHEN 0 THEN 'Visa' WHEN 1 THEN 'Travel' WHEN 2 THEN 'Local/Service' ELSE 'General' END AS given,
         list_concat(['Part ' || j for j in range(1, id % 5 + 1)], CASE id % 9 WHEN 1 THEN ['Process and timeline'] WHEN 2 THEN ['Mistakes to avoid'] ELSE [] END,
           CASE WHEN id % 13 = 5 THEN ['FAQ'] ELSE [] END) AS h2s
       FROM documents),
m1 AS (SELECT *, {collapse("array_to_string(list_filter([" + ", ".join(_PIECES) + "], lambda s: s IS NOT NULL AND s <> ''), ' ')")} AS body, given AS first_type FROM m0),
m2 AS (SELECT *, true AS has_article, {BODY}
         CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN trim(repeat('long words ', 16)) ELSE 'Summary ' || id END AS meta,
         CASE WHEN id % 9 = 4 THEN 'noindex, follow' END AS robots, CASE WHEN id % 3 = 1 THEN 'Social ' || id END AS og,
         id % 3 <> 0 AND id % 4 = 2 AS elsewhere, CASE WHEN id % 10 IN (0, 1) THEN 1 WHEN id % 10 = 5 THEN 2 ELSE 0 END AS n_schema,
         id % 10 = 0 AS faq_schema, id % 6 AS no_alt, (id % 4 = 2)::INT AS tables, len(h2s) AS h2n, (id % 5 = 3)::INT AS lists,
         id % 4 = 1 AS author, id % 5 IN (2, 4) AS dated, (id % 6 = 1)::INT AS official, id % 4 + 3 * (id % 8 = 7)::INT AS links, 3 * (id % 8 = 7)::INT AS weak
       FROM m1),
da AS (SELECT * REPLACE (faq OR id % 11 = 3 AS faq), given AS kind FROM m2),
tgt AS (SELECT article_id, unnest([1, 2, 3, 4]) AS pos FROM da),
cmp AS (SELECT tgt.article_id, tgt.article_id + tgt.pos AS competitor_id, pos, c.has_article IS TRUE AS fetched, coalesce(c.wc, 0) AS their,
          coalesce(c.faq, false) AS their_faq, coalesce(c.tables, 0) AS their_tables, coalesce(c.official, 0) AS their_official, coalesce(c.h2n, 0) AS their_h2, c.title AS their_title
        FROM tgt LEFT JOIN da c ON c.article_id = tgt.article_id + tgt.pos),
avgs AS (SELECT article_id, count(*) AS n_comp, avg(their)::DOUBLE AS mean_words, count(*) FILTER (their_faq) AS n_faq,
           count(*) FILTER (their_tables > 0) AS n_tab FROM cmp GROUP BY article_id),
x AS (SELECT da.*, n_comp, mean_words, n_faq, n_tab, wc AS w, faq AS f, kind IN ('Visa', 'Travel') AS vt,
        mean_words > 0 AND wc < mean_words * 0.6::DOUBLE AS far, phone OR email OR line AS contact FROM da JOIN avgs USING (article_id))
"""


def marked(*parts: str) -> str:
    *ctes, select = parts
    return "WITH " + ", ".join([ARTICLES, *ctes]) + " " + select


_LIKE = "len(list_filter(h2s, lambda s: regexp_matches(s, '(?i){}'))) > 0"
_CHECKS = ["(id // 3) % 3 <> 1", "len(claims) = 0", "official > 0", "lists > 0", _LIKE.format("process|step|timeline"), _LIKE.format("mistake|avoid|reject"),
           "author AND dated", "len(cta) > 0 AND len(claims) = 0", "true", "f AND faq_schema"]
FINDINGS = f"""SELECT x.article_id, coalesce(n, 0) AS n_failures, coalesce(high, 0) AS n_high_failures,
  coalesce(problems, '') AS top_problems, coalesce(fixes, '') AS top_fixes, worst AS worst_failure,
  CASE WHEN n IS NULL THEN 'Keep' ELSE {DECISION} END AS final_decision,
  {_LIST.format(f"[CASE WHEN {_T} <> '' THEN 'title=' || title END, CASE WHEN f THEN 'faq' END, CASE WHEN coalesce(tables, 0) > 0 THEN 'tables=' || tables END, CASE WHEN h2n > 2 THEN 'h2s=' || h2n END]")} AS can_extract,
  {_LIST.format(f"[CASE WHEN {_T} = '' THEN 'no_title' END, CASE WHEN NOT f THEN 'no_faq' END, CASE WHEN coalesce(tables, 0) = 0 THEN 'no_table' END, CASE WHEN h2n <= 2 THEN 'few_h2' END]")} AS cannot_extract,
  {_LIST.format(f"[CASE WHEN len(years) > 0 THEN {_YEARS} END, CASE WHEN NOT dated THEN 'no_date' END, CASE WHEN kind = 'Visa' THEN 'visa_rules_change' END]")} AS freshness_risks,
  {_LIST.format("[CASE WHEN coalesce(len(cta), 0) = 0 THEN 'no_cta' END, CASE WHEN kind = 'Local/Service' AND NOT contact THEN 'service_contact' END, CASE WHEN coalesce(len(cta), 0) = 0 THEN 'cta_phrases' END]")} AS conversion_issues
  FROM x LEFT JOIN fa USING (article_id)"""

SQL = {
    "input_parsing": docs(r"""SELECT article_id, len(urls)::BIGINT AS n_urls, main_url,
        list_extract([u for u in urls if contains(lower(u), 'sitemap')], -1) AS sitemap_url,
        greatest(0, len([u for u in urls if not contains(lower(u), 'sitemap')]) - 1)::BIGINT AS n_competitors,
        has_html, length(raw_text)::BIGINT AS text_length, keyword AS detected_keyword,
        language AS detected_language, first_type AS detected_article_type,
        regexp_extract(main_url, '^([a-z]+://[^/?#]+)', 1) AS website_base_url,
        CASE WHEN main_url IS NULL AND NOT has_html AND raw_text IS NULL THEN 10 ELSE least(95, 50
          + CASE WHEN len(urls) > 0 THEN 20 ELSE 0 END + CASE WHEN keyword IS NOT NULL THEN 15 ELSE 0 END
          + CASE WHEN has_html THEN 10 ELSE 0 END + CASE WHEN raw_text IS NOT NULL THEN 10 ELSE 0 END) END::BIGINT AS confidence,
        main_url IS NULL AND NOT has_html AND raw_text IS NULL AS has_no_input FROM d3"""),
    "input_modes": rf"SELECT doc_id, NOT contains({_TRIM}, chr(10)) AND length({_TRIM}) <= 200 "
                   rf"AND NOT contains({_TRIM}, ' ') AS is_site FROM documents",
    "article_text": docs("SELECT article_id, has_article, wc::BIGINT AS word_count, head AS first_300_words, "
                         "length(substr(body, 1, 10000))::BIGINT AS main_text_length FROM da"),
    "article_signals": docs("""SELECT article_id, faq AS has_faq, phone AS has_phone, email AS has_email,
        line AS has_line, phone OR email OR line AS has_contact_info,
        array_to_string(cta, '|') AS cta_phrases,
        array_to_string(claims, '|') AS overclaims, false AS has_author, false AS has_date FROM da"""),
    "article_questions": docs("SELECT article_id, coalesce(array_to_string(asked, '|'), '') AS questions_found FROM da"),
    "article_repeated_phrases": docs(r"""
        , ws AS (SELECT article_id, string_split(lower(body), ' ') AS w FROM da WHERE has_article),
        bg AS (SELECT article_id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w) - 1)]) AS p,
                 unnest([i for i in range(1, len(w) - 1)]) AS i FROM ws),
        rp AS (SELECT article_id, p, min(i) AS i FROM bg WHERE length(p) > 5 GROUP BY 1, 2 HAVING count(*) >= 5),
        ls AS (SELECT article_id, array_to_string(list(p ORDER BY i), '|') AS l FROM rp GROUP BY 1)
        SELECT da.article_id, CASE WHEN has_article THEN coalesce(l, '') END AS repeated_phrases
        FROM da LEFT JOIN ls ON da.article_id = ls.article_id""").replace(" \n        , ws", ", ws"),
    "article_old_years": docs("SELECT article_id, array_to_string(years, '|') AS old_years FROM da"),
    "article_types": docs("SELECT article_id, kind AS detected_article_type, keyword AS detected_keyword FROM da"),
    "article_scores": docs(COMPETITORS, SCORES, "SELECT article_id, position::BIGINT AS position, category, "
                           "score::BIGINT AS score, max_score::BIGINT AS max_score, status, evidence FROM sc"),
    "article_verdicts": docs(COMPETITORS, SCORES, f"""SELECT article_id, total, 100::BIGINT AS max_total,
        {VERDICT} AS verdict, CASE WHEN total >= 88 THEN 'green' WHEN total >= 70 THEN 'yellow'
        WHEN total >= 50 THEN 'orange' ELSE 'red' END AS band FROM tot"""),
    "article_failures": docs(COMPETITORS, FAILURES, "SELECT article_id, rank, type, confidence, evidence, "
                             "impact, fix, effort, priority FROM fl"),
    "article_findings": docs(COMPETITORS, FAILURES, FINDINGS),
    "markup_article_features": marked("""SELECT article_id, title, h1, array_to_string(h2s, '|') AS h2s,
        array_to_string(['Step ' || j for j in range(1, id % 3 + 1)], '|') AS h3s, (CASE WHEN h1 IS NULL THEN 0 ELSE 1 END + h2n + id % 3)::BIGINT AS n_headings,
        meta AS meta_description, robots AS meta_robots, og AS og_title,
        CASE id % 4 WHEN 1 THEN 'https://mag' || k || '.example.com/x' WHEN 2 THEN 'https://other.example.net/' || id END AS canonical,
        CASE id % 10 WHEN 0 THEN 'FAQPage' WHEN 1 THEN 'Article,Thing' WHEN 5 THEN 'WebPage|Organization' ELSE '' END AS schema_types,
        w::BIGINT AS word_count, 1::BIGINT AS paragraph_count, tables::BIGINT AS table_count, lists::BIGINT AS list_count,
        (no_alt + (id % 2 = 0)::INT)::BIGINT AS image_count, no_alt::BIGINT AS missing_alt_count,
        array_to_string(list_concat(['/p' || j || ' Page ' || j for j in range(1, id % 4 + 1)], CASE WHEN weak > 0 THEN ['/w' || j || ' click here' for j in range(1, 4)] ELSE [] END), '|') AS internal_links,
        CASE id % 6 WHEN 1 THEN 'https://embassy.example.gov/v' WHEN 2 THEN 'https://ads.example.org/z' ELSE '' END AS external_links,
        CASE WHEN id % 6 = 2 THEN 'https://ads.example.org/z' ELSE '' END AS nofollow_links, weak::BIGINT AS weak_anchor_count,
        CASE WHEN author THEN 'Ann ' || id END AS author_name, CASE id % 5 WHEN 2 THEN '2024-03-01' WHEN 4 THEN 'May ' || id END AS date_text,
        author AS has_author, dated AS has_date, f AS has_faq, array_to_string(cta, '|') AS cta_phrases, phone AS has_phone, email AS has_email, line AS has_line,
        array_to_string(asked, '|') AS questions_found, array_to_string(claims, '|') AS overclaims,
        CASE WHEN official > 0 THEN 'https://embassy.example.gov/v' ELSE '' END AS official_source_links, array_to_string(years, '|') AS old_years,
        head AS first_300_words FROM x"""),
    "markup_article_scores": marked(SCORES, "SELECT article_id, position::BIGINT AS position, category, "
                                    "score::BIGINT AS score, max_score::BIGINT AS max_score, status, evidence FROM sc"),
    "markup_article_verdicts": marked(SCORES, f"SELECT article_id, total, 100::BIGINT AS max_total, {VERDICT} AS verdict FROM tot"),
    "markup_article_failures": marked(FAILURES, "SELECT article_id, rank, type, confidence, evidence, impact, fix, effort, priority FROM fl"),
    "markup_article_findings": marked(FAILURES, FINDINGS),
    "markup_article_checklist": marked(f"""SELECT article_id, CASE WHEN vt THEN array_to_string([({'), ('.join(_CHECKS)})], '|') END AS checklist,
        CASE WHEN vt THEN 10 * ({' + '.join(f'({x})::INT' for x in _CHECKS)}) END::BIGINT AS checklist_percent FROM x"""),
    "markup_article_rivals": marked("""SELECT cmp.article_id, competitor_id, pos::BIGINT AS position, fetched,
        (CASE WHEN fetched THEN their ELSE 0 END)::BIGINT AS word_count, (CASE WHEN fetched THEN their_h2 ELSE 0 END)::BIGINT AS h2_count,
        fetched AND their_faq AS has_faq, fetched AND their_tables > 0 AS has_table, fetched AND their_official > 0 AS has_official_sources,
        (CASE WHEN fetched AND their_title IS NOT NULL THEN least(100, length(their_title) * 2) ELSE 0 END)::BIGINT AS title_score,
        CASE WHEN NOT fetched THEN 'unfetched' ELSE array_to_string(list_filter([
          CASE WHEN their > w * 1.2::DOUBLE THEN 'longer=' || their END, CASE WHEN their_faq AND NOT f THEN 'has_faq' END,
          CASE WHEN their_tables > 0 AND tables = 0 THEN 'has_tables' END, CASE WHEN their_official > official THEN 'more_official' END,
          CASE WHEN their_h2 > h2n THEN 'more_h2s=' || their_h2 END], lambda s: s IS NOT NULL), '|') END AS what_they_do_better,
        CASE WHEN NOT fetched THEN '' ELSE array_to_string(list_filter([
          CASE WHEN their > w * 1.2::DOUBLE THEN 'missing_words=' || (their - w) END, CASE WHEN their_faq AND NOT f THEN 'no_faq' END,
          CASE WHEN their_tables > 0 AND tables = 0 THEN 'no_table' END, CASE WHEN their_official > official THEN 'more_sources' END,
          CASE WHEN their_h2 > h2n THEN 'more_sections' END], lambda s: s IS NOT NULL), '|') END AS what_we_lack
        FROM cmp JOIN x USING (article_id)"""),
    "markdown_report_heads": docs(NO_RIVALS, SCORES, FAILURES, f"""SELECT article_id AS id, '# Audit of an article' || chr(10) || chr(10) || array_to_string([
        '- Page: ' || coalesce(main_url, 'pasted text'), '- Keyword: ' || coalesce(keyword, 'not given'), '- Day: 5 March 2024',
        '- Kind of article: ' || kind, '- Language: ' || language, '- Points: ' || total || ' of 100', '- Rating: ' || {VERDICT}, '- Decision: ' || {DECISION}], chr(10)) AS head
        FROM x JOIN tot USING (article_id) JOIN fa USING (article_id)"""),
    "rewrite_prompts": docs(NO_RIVALS, SCORES, FAILURES, f"""SELECT article_id AS id, array_to_string([
        'Write this article anew, so that it serves the reader who searches for its keyword.',
        array_to_string(['Page: ' || coalesce(main_url, 'pasted text'), 'Keyword: ' || coalesce(keyword, 'not given'), 'Kind: ' || kind, 'Language: ' || language,
          'Points of a hundred: ' || total, 'Rating: ' || {VERDICT}], chr(10)),
        'Faults:' || chr(10) || array_to_string([i || '. ' || s for s, i in string_split(problems, '|')], chr(10)), 'Outline:' || chr(10), 'Questions:' || chr(10),
        array_to_string(['Rules:', '- the answer comes first', CASE WHEN vt THEN '- facts link the authority in charge' ELSE '- facts have sources' END,
          CASE WHEN language IN ('Thai', 'Thai/English mixed') THEN '- plain Thai' ELSE '- plain English' END, '- no promises'], chr(10)),
        'Text:' || chr(10) || coalesce(nullif(substr(body, 1, 10000), ''), '(no text)')], chr(10) || chr(10)) AS rewrite_prompt
        FROM x JOIN tot USING (article_id) JOIN fa USING (article_id)"""),
    "article_contexts": docs("""SELECT article_id, array_to_string(['Page: ' || coalesce(main_url, 'pasted text'), 'Keyword: ' || coalesce(keyword, '-'),
        'Language: ' || language || ' | Type: ' || kind, 'Title tag: -', 'Meta description: -', 'H1: -', 'H2s: -', 'Word count: ' || coalesce(wc, 0), 'Tables: 0', 'Lists: 0', 'Images: 0',
        'FAQ section: ' || CASE WHEN faq THEN 'YES' ELSE 'NO' END, 'Author: -', 'Date: -', 'Schema types: -', 'Internal links: 0', 'Official sources: -',
        'Overclaims: ' || coalesce(nullif(array_to_string(claims, '; '), ''), '-'), 'Text:', coalesce(nullif(substr(body, 1, 10000), ''), head, '(no text)')], chr(10)) AS context FROM da"""),
    "competitor_gaps": docs(COMPETITORS, """SELECT cmp.article_id, competitor_id, pos::BIGINT AS position, fetched,
        (CASE WHEN fetched THEN their ELSE 0 END)::BIGINT AS word_count, 0::BIGINT AS h2_count,
        fetched AND their_faq AS has_faq, false AS has_table, false AS has_official_sources, 0::BIGINT AS title_score,
        CASE WHEN NOT fetched THEN 'unfetched' ELSE array_to_string(list_filter([
          CASE WHEN their > w * 1.2::DOUBLE THEN 'longer=' || their END,
          CASE WHEN their_faq AND NOT f THEN 'has_faq' END], lambda s: s IS NOT NULL), '|') END AS what_they_do_better,
        CASE WHEN NOT fetched THEN '' ELSE array_to_string(list_filter([
          CASE WHEN their > w * 1.2::DOUBLE THEN 'missing_words=' || (their - w) END,
          CASE WHEN their_faq AND NOT f THEN 'no_faq' END], lambda s: s IS NOT NULL), '|') END AS what_we_lack
        FROM cmp JOIN x USING (article_id)"""),
    "competitor_averages": docs(COMPETITORS, """SELECT article_id, n_comp AS n_competitors,
        mean_words AS competitor_mean_words, n_faq AS n_competitors_with_faq,
        0::BIGINT AS n_competitors_with_tables FROM avgs"""),
    "scan_rows": docs(COMPETITORS, SCORES, FAILURES, SCANS, """SELECT id, raw_input, score, verdict, final_decision,
        (score::BIGINT)::VARCHAR AS json_total, n AS json_failures
        FROM sn JOIN fa ON sn.id = fa.article_id::VARCHAR"""),
    "recent_scans": docs(COMPETITORS, SCORES, FAILURES, SCANS,
                         f"SELECT {_LISTED} FROM sn ORDER BY created_at DESC, id LIMIT 50"),
    "scan_by_id": docs(COMPETITORS, SCORES, FAILURES, SCANS, f"SELECT {_LISTED} FROM sn WHERE id = '7'"),
    "scans_after_delete": docs(COMPETITORS, SCORES, FAILURES, SCANS, f"SELECT {_LISTED} FROM sn WHERE id::BIGINT % 7 <> 3 AND id::BIGINT % 90 <> 41"),
    "escaped_text": "SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), "
                    "'>', '&gt;'), '\"', '&quot;') AS html FROM documents",
    "page_article_counts": pages(r"""SELECT page_id AS article_id, title,
        nullif(trim(H1RAW), '') AS h1, len(regexp_extract_all(body_text, '[^ ]+'))::BIGINT AS word_count,
        paragraph_count::BIGINT AS paragraph_count,
        len(regexp_extract_all(h, '(?i)<(?:ul|ol)[\s/>]'))::BIGINT AS list_count, 0::BIGINT AS table_count,
        len(pieces)::BIGINT AS internal_links, 0::BIGINT AS external_links, 0::BIGINT AS nofollow_links,
        len([p for p in pieces if regexp_matches(ANCHOR, '(?i)click here|read more|here|link')])::BIGINT AS weak_anchor_count,
        (h1 IS NOT NULL)::BIGINT AS headings FROM pf""".replace(
            "H1RAW", decode(strip_tags(r"regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1\s*>', 1)"))).replace(
            "ANCHOR", decode(r"regexp_replace(regexp_extract(p, '(?is)^[^>]*>(.*?)(?:</a\s*>|\z)', 1), '<[^>]*>', '', 'g')"))),
    "safe_inputs": "SELECT conv_id, turn, role FROM conversations WHERE NOT regexp_matches(text, "
                   + q(any_word(fv.BLACK_HAT_WORDS)) + ")",
    "unsafe_inputs": "SELECT conv_id, turn, role FROM conversations WHERE regexp_matches(text, "
                     + q(any_word(fv.BLACK_HAT_WORDS)) + ")",
}
