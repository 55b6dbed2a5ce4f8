"""Shared DuckDB fragments: the same results as the Spark operators, written independently in SQL."""

WS = r"\s"
NOISE = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script(?:[\s/][^>]*)?>.*?(?:</script\s*>|\z)"
    r"|<style(?:[\s/][^>]*)?>.*?(?:</style\s*>|\z)"
    r"|<noscript(?:[\s/][^>]*)?>.*?(?:</noscript\s*>|\z)"
    r"|<svg(?:[\s/][^>]*)?>.*?(?:</svg\s*>|\z)"
)
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@\\\s]*@)?([^/:?#\\\s]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\\\s]+(/[^?#]*)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def decode(x: str) -> str:
    for entity, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"),
                         ("&gt;", ">"), ("&amp;", "&"), ("&amp", "&")):
        x = f"replace({x}, {q(entity)}, {q(char)})"
    return x


def strip_tags(x: str) -> str:
    return f"regexp_replace({x}, {q('<[a-zA-Z/!?][^>]*(?:>|' + chr(92) + 'z)')}, '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def text_of(x: str) -> str:
    return collapse(decode(strip_tags(x)))


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, {q(HOST)}, 1))"


def site(url: str) -> str:
    return f"regexp_replace({host(url)}, '^www\\.', '')"


def path(url: str) -> str:
    return (f"(CASE WHEN regexp_extract({url}, {q(PATH)}, 1) = '' THEN '/' "
            f"ELSE regexp_extract({url}, {q(PATH)}, 1) END)")


def segments(p: str) -> str:
    return f"[s for s in string_split({p}, '/') if s <> '']"


def page_type(p: str) -> str:
    rules = (
        ("product", "/(products?|สินค้า|item)/"),
        ("category", "/(collections?|category|หมวด|catalog|หมวดหมู่)/"),
        ("service", "/(service|บริการ|solution)/"),
        ("faq", "/(faq|คำถาม|help|ช่วยเหลือ)"),
        ("about", "/(about|เกี่ยวกับ|ทีม|team)"),
        ("contact", "/(contact|ติดต่อ)"),
        ("podcast", "/(podcast|episode|ep)/"),
        ("blog", "/(blog|news|article|บทความ|ข่าว|insight|learn)/"),
        ("policy", "/(policy|term|privacy|return|refund|นโยบาย)"),
    )
    cases = " ".join(f"WHEN regexp_matches(lower({p}), {q(r)}) THEN {q(n)}" for n, r in rules)
    return f"(CASE {cases} WHEN {p} = '/' THEN 'home' ELSE 'other' END)"


def encoded(x: str) -> str:
    return (f"array_to_string([CASE WHEN regexp_matches(ch, '[^!-~]|[\"<>`{{}}]') "
            f"THEN url_encode(ch) ELSE ch END for ch in string_split({x}, '')], '')")


WORDS = "[^ ]+"

# One row per page of the given table, with the features that occur in it.
PAGES = rf"""
pg0 AS (
  SELECT page_id, url, html, {host('url')} AS host, {site('url')} AS site, {path('url')} AS path,
         regexp_replace(html, {q(NOISE)}, '', 'g') AS h
  FROM pages),
pg1 AS (
  SELECT *,
    nullif(trim({decode("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title" + chr(92) + "s*>', 1)")}), '') AS title,
    nullif({text_of("regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1" + chr(92) + "s*>', 1)")}, '') AS h1,
    len(regexp_extract_all(h, '(?i)<h1[\s/>]')) AS h1_count,
    len(regexp_extract_all(h, '(?i)<p[\s/>]')) AS paragraph_count,
    {text_of("regexp_extract(h, '(?is)<article[^>]*>(.*?)</article" + chr(92) + "s*>', 1)")} AS zone_text,
    {text_of("regexp_extract(h, '(?is)<body[^>]*>(.*)', 1)")} AS body_text,
    string_split_regex(h, '(?i)<a[\s/]')[2:] AS pieces,
    {page_type('path')} AS page_type
  FROM pg0),
pf AS (
  SELECT *,
    CASE WHEN length(zone_text) > 50 THEN zone_text ELSE body_text END AS content,
    len(regexp_extract_all(CASE WHEN length(zone_text) > 50 THEN zone_text ELSE body_text END,
                           '[^ ]{{2,}}')) AS word_count,
    len(pieces) AS internal_link_count,
    regexp_matches(CASE WHEN length(zone_text) > 50 THEN zone_text ELSE body_text END,
      '(?i)(\+66|0[0-9]{{8,9}}|@|line\.me|facebook\.com|LINE ID)') AS has_contact_info,
    regexp_matches(url, '(?i)(?:^|[^A-Za-z0-9_])(?:faq|frequently|question)')
      OR regexp_matches(coalesce(title, ''), '(?i)(?:^|[^A-Za-z0-9_])(?:faq|frequently|question)')
      AS has_faq,
    [w for w in [regexp_replace(t, '[^a-z0-9ก-๙]', '', 'g')
                 for t in string_split_regex(lower(coalesce(title, '')), '[\s|,\-–—:]+')]
     if length(w) >= 3] AS title_keywords
  FROM pg1)
"""


def pages(sql: str) -> str:
    return f"WITH {PAGES} {sql}"


def top_k(relation: str, keys: str, order: str, k: int, rank: str = "rank") -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) "
            f"AS {rank} FROM {relation}) WHERE {rank} <= {k}")
