"""Features of single articles: pasted text, documents, or fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright import fixed_values as fv
from sitewright.functions import html as H
from sitewright.functions import urls as U
from sitewright.functions.text import (
    collapse_ws, compact, contains_any, count_words, decode_entities, keep, let, null_if_blank, strip_tags,
    trim_ws,
)
from sitewright.operators.inputs import body_article_type
from sitewright.operators.page_features import schema_nodes

_AUTHOR = "(?:" + "|".join((
    H.tag_with("rel", value="author"), H.tag_with("class", part="author"),
    H.tag_with("itemprop", value="author"),
)) + ")"
_DATE = "(?:" + "|".join((
    r"<(?i:time)(?=[\s/>])",
    H.tag_with("itemprop", value="(?:datePublished|dateModified)"),
    H.tag_with("class", part="date"),
)) + ")"
_FAQ_MARKUP = (H.tag_with("itemtype", part="FAQPage"), H.tag_with("class", token="faq"))
_PHONE = (
    r"(?=[0-9])(?:(?<![A-Za-z0-9_])[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}(?![A-Za-z0-9_])"
    r"|0[689][0-9]{8})"
)
_EMAIL = r"[A-Za-z0-9_][.%+-]*@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}(?:$|[^A-Za-z0-9_])"
_OLD_YEAR = r"(?=20[12])(?<![A-Za-z0-9_])(201[0-9]|202[0-2])(?![A-Za-z0-9_])"


def _plain(c: Column) -> Column:
    return trim_ws(decode_entities(strip_tags(c)))


def _first_attr(h: Column, pattern: str, name: str) -> Column:
    return null_if_blank(H.attr(F.regexp_extract(h, pattern + "[^>]*>", 0), name))


def questions(text: Column) -> Column:
    """Sentences that end in a question mark, 11 to 199 characters."""
    parts = F.regexp_extract_all(text, F.lit(r"[^.!?]*+(?:[.!?]|\z)"), F.lit(0))
    asked = F.transform(F.filter(parts, lambda q: q.endswith("?")), lambda q: F.trim(q))
    sized = F.filter(asked, lambda q: F.length(q).between(11, 199))
    found = F.when(text.contains("?"), sized)
    return F.coalesce(found, F.array().cast("array<string>"))


def _repeated(ordered: str) -> Column:
    """Bigrams seen five times or more, by first position.

    `ordered` is the sorted list of (phrase, at): a phrase at i that equals the one at i+4 but not
    the one at i-1 starts a run of at least five, and carries its first position.  The work stays
    inside the row, so nothing is shuffled.
    """
    starts = F.filter(
        ordered,
        lambda x, i: (x["phrase"] == F.get(ordered, i + 4)["phrase"])
        & ((i == 0) | (F.get(ordered, i - 1)["phrase"] != x["phrase"])),
    )
    placed = F.array_sort(F.transform(starts, lambda x: F.struct(x["at"], x["phrase"])))
    return F.transform(placed, lambda x: x["phrase"])


def _in_sequence(low: Column, words) -> Column:
    """The words occur in `low`, each after the one before it."""
    if len(words) == 1:
        return F.contains(low, F.lit(words[0]))
    return contains_any(low, words[:1]) & low.rlike(".*".join(words))


def _links(pieces: Column) -> Column:
    def parts(p: Column) -> Column:
        return let(
            F.regexp_extract(p, H.ANCHOR_HEAD, 1),
            lambda head: F.struct(
                H.attr(head, "href").alias("href"),
                H.anchor_text(p).alias("text"),
                H.attr(head, "rel").contains("nofollow").alias("nofollow"),
            ),
        )

    return F.transform(pieces, parts)


def article_features(articles: DataFrame, *, bare_references: bool = True) -> DataFrame:
    """All columns of `articles` but `html`, and the features of the article in `html`.

    Needs `article_id`, `url` (may be null) and `html`; null html means that there is no article,
    and every feature is null.  `bare_references` is that of `page_features`.
    """
    c = F.col
    kept = H.strip_noise(c("html"), svg=False)
    passed = [n for n in articles.columns if n != "html"]
    if "final_url" not in passed:
        articles = articles.withColumn("final_url", F.lit(None).cast("string"))
        passed.append("final_url")
    df = articles.withColumns({
        "_h": kept if bare_references else H.bare_references_as_text(kept),
        "_host": U.host(c("url")),
        "schema_types": F.transform(
            schema_nodes(H.json_ld_blocks(c("html"))), lambda n: n["type"]),
    })
    df = df.withColumns({
        "_t": H.tag_text(c("_h")),
        "body_text": collapse_ws(decode_entities(strip_tags(H.body_markup(c("_h"))))),
        "links": _links(H.anchor_pieces(c("_h"))),
    })
    df = df.withColumn("_lower", F.lower("body_text"))
    df = df.withColumns({
        "_metas": H.tags(c("_t"), "meta"),
        "_link_tags": H.tags(c("_t"), "link"),
        "_imgs": H.tags(c("_t"), "img"),
        "_words": F.split("body_text", " "),
        "_lower_words": F.split("_lower", " "),
        "main_text": F.substring("body_text", 1, 10000),
        "h1": null_if_blank(_plain(F.regexp_extract("_h", H.element("h1"), 1))),
        "h2s": F.transform(F.regexp_extract_all("_h", F.lit(H.element("h2")), F.lit(1)), _plain),
        "h3s": F.transform(F.regexp_extract_all("_h", F.lit(H.element("h3")), F.lit(1)), _plain),
        "_hrefs": F.transform("links", lambda x: x["href"]),
        "_has_author_markup": c("_t").contains("author"),
    })
    df = df.withColumns({
        "title": null_if_blank(
            trim_ws(decode_entities(F.regexp_extract("_h", H.element("title"), 1)))),
        "meta_description": H.meta_content(c("_metas"), "name", "description"),
        "meta_robots": H.meta_content(c("_metas"), "name", "robots"),
        "og_title": H.meta_content(c("_metas"), "property", "og:title"),
        "og_description": H.meta_content(c("_metas"), "property", "og:description"),
        "canonical": null_if_blank(trim_ws(H.attr(
            F.get(F.filter("_link_tags", lambda t: t.rlike(
                H.tag_with("rel", value="canonical", name="link"))), F.lit(0)), "href"))),
        "word_count": count_words(c("body_text")),
        "paragraph_count": H.count_tags(c("_t"), "p"),
        "table_count": H.count_tags(c("_t"), "table"),
        "list_count": H.count_tags(c("_t"), "(?:ul|ol)"),
        "image_count": F.size("_imgs"),
        "missing_alt_count": F.size(F.filter("_imgs", lambda t: H.attr(t, "alt") == "")),
        "internal_links": F.filter(
            "links",
            lambda x: F.when(
                x["href"].startswith("http"),
                F.coalesce(F.contains(x["href"], c("_host")), F.lit(False)),
            ).otherwise(x["href"].rlike("^[/#]"))),
        "external_links": F.filter(
            "links",
            lambda x: x["href"].startswith("http")
            & ~F.coalesce(F.contains(x["href"], c("_host")), F.lit(False))),
        "nofollow_links": F.transform(
            F.filter("links", lambda x: x["nofollow"]), lambda x: x["href"]),
        "author_name": F.when(
            c("_has_author_markup"), null_if_blank(_plain(H.first_inner(c("_h"), _AUTHOR)))),
        "date_text": F.when(c("_t").rlike(_DATE), F.coalesce(
            _first_attr(c("_t"), _DATE, "datetime"),
            null_if_blank(_plain(H.first_inner(c("_h"), _DATE))))),
        "has_faq": contains_any(c("_lower"), fv.ARTICLE_FAQ_WORDS)
        | c("_t").rlike(_FAQ_MARKUP[0]) | c("_t").rlike(_FAQ_MARKUP[1])
        | F.exists("h2s", lambda t: t.rlike("(?i)faq|คำถาม")),
        "cta_phrases": compact(*[
            keep(F.contains(c("_lower"), F.lit(p)), p) for p in fv.CTA_PHRASES]),
        "has_phone": c("body_text").rlike(_PHONE),
        "has_email": c("body_text").contains("@") & c("body_text").rlike(_EMAIL),
        "has_line": contains_any(c("_lower"), fv.LINE_WORDS)
        | (c("body_text").contains("@") & c("body_text").rlike(fv.LINE_HANDLE_PATTERN)),
        "first_300_words": F.array_join(F.slice("_words", 1, 300), " "),
        "all_headings": F.filter(
            F.concat(F.array(c("h1")), c("h2s"), c("h3s")), lambda t: F.coalesce(t, F.lit("")) != ""),
        "questions_found": questions(c("body_text")),
        "_bigrams": F.filter(
            F.transform(
                F.slice("_lower_words", F.lit(1), F.greatest(F.size("_lower_words") - 2, F.lit(0))),
                lambda w, i: F.concat(w, F.lit(" "), F.get("_lower_words", i + 1))),
            lambda p: F.length(p) > 5),
        "overclaims": compact(*[
            keep(_in_sequence(c("_lower"), words), label) for label, words in fv.OVERCLAIMS]),
        "official_source_links": F.filter("_hrefs", lambda u: u.rlike(fv.OFFICIAL_LINK_PATTERN)),
        "old_years": F.regexp_extract_all("body_text", F.lit(_OLD_YEAR), F.lit(1)),
        "body_article_type": body_article_type(c("_lower")),
    })
    df = df.withColumn("_sorted_bigrams", F.sort_array(F.transform(
        "_bigrams", lambda p, i: F.struct(p.alias("phrase"), i.alias("at")))))
    return df.select(
        *passed,
        c("html").isNotNull().alias("has_article"),
        "title", "meta_description", "canonical", "meta_robots", "og_title", "og_description",
        "h1", "h2s", "h3s", "all_headings", "schema_types",
        "word_count", "main_text", "first_300_words",
        "paragraph_count", "table_count", "list_count", "image_count", "missing_alt_count",
        "internal_links", "external_links", "nofollow_links",
        F.size(F.filter("internal_links", lambda x: x["text"].rlike(fv.WEAK_ANCHOR_PATTERN)))
        .alias("weak_anchor_count"),
        "author_name", c("author_name").isNotNull().alias("has_author"),
        "date_text", c("date_text").isNotNull().alias("has_date"),
        "has_faq", "cta_phrases", (F.size("cta_phrases") > 0).alias("has_cta_section"),
        "has_phone", "has_email", "has_line",
        (c("has_phone") | c("has_email") | c("has_line")).alias("has_contact_info"),
        "questions_found",
        _repeated("_sorted_bigrams").alias("repeated_phrases"),
        "overclaims", "official_source_links", "old_years", "body_article_type",
    )
