"""Reading of raw pasted input: URLs and their roles, language, article type, keyword, safety."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright import fixed_values as fv
from sitewright.functions import urls as U
from sitewright.functions.text import contains_any, first_case, let, null_if_blank, trim_ws

_URL = r"""(?i)https?://[^\s<>"{}|\\^`\[\]]+"""
_KEYWORD = r"(?i)(?:keywords?|คีย์เวิร์ด)\s*:\s*([^\n]+)"
_HTML = r"(?i)<\s*(?:html|head|body|article|div|h[1-6]|p|section)(?![A-Za-z0-9_])"


def is_safe_input(text: Column) -> Column:
    """False for text that asks for a black-hat tactic."""
    return let(F.lower(text), lambda low: ~contains_any(low, fv.BLACK_HAT_WORDS))


def safe_inputs(df: DataFrame, column: str = "text") -> DataFrame:
    return df.filter(is_safe_input(F.col(column)))


def is_site_input(text: Column) -> Column:
    """One line of at most 200 characters without a space names a site, else it is an article."""
    t = trim_ws(text)
    return ~t.contains("\n") & (F.length(t) <= 200) & ~t.contains(" ")


def urls_in_text(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(_URL), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", "")))


def language(text: Column) -> Column:
    """Language by letter counts; letters are counted only in text that has Thai letters at all."""
    thai = F.length(F.regexp_replace(text, "[^฀-๿]+", ""))
    latin = F.length(F.regexp_replace(text, "[^a-zA-Z]+", ""))
    counted = let(
        F.struct(thai.alias("thai"), latin.alias("latin")),
        lambda n: F.when(
            n["latin"] > 0,
            F.when(n["thai"] > n["latin"] * 0.5, "Thai/English mixed").otherwise("English"),
        ).when(n["thai"] > 10, "Thai").otherwise("Unknown"),
    )
    more_than_ten = text.rlike("(?:[a-zA-Z][^a-zA-Z]*+){11}")
    return F.when(text.rlike("[฀-๿]"), counted).when(more_than_ten, "English").otherwise("Unknown")


def article_type(text: Column) -> Column:
    def decide(low: Column) -> Column:
        cases = [(n, contains_any(low, words)) for n, words in fv.ARTICLE_TYPE_WORDS]
        return first_case(cases, F.lit("General"))

    return let(F.lower(text), decide)


def body_article_type(lower_body: Column) -> Column:
    """The type that a lower-case article body shows, `General` where none; null stays null."""
    cases = [(n, contains_any(lower_body, words)) for n, words in fv.ARTICLE_TYPE_UPGRADE_WORDS]
    return F.when(lower_body.isNotNull(), first_case(cases, F.lit("General")))


def upgraded_type(current: Column, body_type: Column) -> Column:
    """A `General` input takes the type that the whole body of the article shows."""
    return F.when(current == "General", F.coalesce(body_type, current)).otherwise(current)


def slug_keyword(url: Column) -> Column:
    parts = F.filter(F.split(url, "/"), lambda s: s != "")
    last = F.replace(F.try_element_at(parts, F.lit(-1)), F.lit("-"), F.lit(" "))
    return null_if_blank(trim_ws(F.regexp_replace(last, r"(?i)\.(html|php|aspx)$", "")))


def inferred_keyword(url: Column, h1: Column, title: Column) -> Column:
    """Keyword of an article without one: URL slug, else h1, else the head of the title."""
    head = null_if_blank(trim_ws(F.regexp_replace(title, r"[-|–—].*$", "")))
    guess = F.coalesce(slug_keyword(url), h1, head)
    return F.when(F.length(guess) < 80, guess)


def parse_inputs(df: DataFrame, column: str = "raw_input") -> DataFrame:
    """All columns of `df`, and what the raw input in `column` says about itself."""
    c = F.col
    df = df.withColumn("_in", trim_ws(c(column)))
    df = df.withColumns({
        "detected_urls": urls_in_text(c("_in")),
        "_without_urls": trim_ws(F.regexp_replace("_in", _URL, "")),
        "_has_html": c("_in").rlike(_HTML),
        "detected_keyword": null_if_blank(trim_ws(F.regexp_extract("_in", _KEYWORD, 1))),
        "detected_language": language(c("_in")),
    })
    df = df.withColumns({
        "_others": F.filter(
            "detected_urls", lambda u: ~F.contains(F.lower(u), F.lit("sitemap"))),
        "sitemap_url": F.try_element_at(F.filter(
            "detected_urls", lambda u: F.contains(F.lower(u), F.lit("sitemap"))), F.lit(-1)),
        "raw_html": F.when(c("_has_html"), c("_in")),
        "raw_article_text": F.when(
            ~c("_has_html") & (F.length("_without_urls") > 150), c("_without_urls")),
    })
    df = df.withColumns({
        "main_url": F.get("_others", F.lit(0)),
        "competitor_urls": F.slice("_others", F.lit(2), F.greatest(F.size("_others") - 1, F.lit(0))),
    })
    subject = F.concat(c("_in"), F.coalesce(c("main_url"), F.lit("")))
    points = (
        F.lit(50)
        + F.when(F.size("detected_urls") > 0, 20).otherwise(0)
        + F.when(c("detected_keyword").isNotNull(), 15).otherwise(0)
        + F.when(c("raw_html").isNotNull(), 10).otherwise(0)
        + F.when(c("raw_article_text").isNotNull(), 10).otherwise(0)
    )
    nothing = (
        c("main_url").isNull() & c("raw_html").isNull() & c("raw_article_text").isNull()
    )
    df = df.withColumns({
        "detected_article_type": article_type(subject),
        "website_base_url": F.concat(
            U.scheme(c("main_url")), F.lit("://"), U.host(c("main_url"))),
        "confidence": F.when(nothing, 10).otherwise(F.least(points, F.lit(95))),
        "has_no_input": nothing,
    })
    return df.drop("_in", "_without_urls", "_has_html", "_others")


def input_markup(parsed: DataFrame) -> DataFrame:
    """`html` of an input without a fetched page: its own markup, else its text as a body."""
    body = F.concat(F.lit("<html><body>"), "raw_article_text", F.lit("</body></html>"))
    return parsed.withColumn("html", F.coalesce("raw_html", body))


def complete_inputs(articles: DataFrame) -> DataFrame:
    """Article type and keyword of parsed inputs, completed from the features of the article."""
    c = F.col
    return articles.withColumns({
        "detected_article_type": upgraded_type(c("detected_article_type"), c("body_article_type")),
        "detected_keyword": F.coalesce(
            c("detected_keyword"), inferred_keyword(c("main_url"), c("h1"), c("title"))),
    })
