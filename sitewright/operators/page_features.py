"""One wide row of features per crawled page.

The operator is a narrow projection: no shuffle, no Python.  It is written in layers because each
layer is read several times by the next; Catalyst keeps such layers apart instead of copying a
regular expression into every reader, and drops the parts no one asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright import fixed_values as fv
from sitewright.functions import html as H
from sitewright.functions import urls as U
from sitewright.functions.text import (
    any_rlike, collapse_ws, contains_any, count_words, decode_entities, let, markup_text, null_if_blank, trim_ws,
)
from sitewright.sources.pages import with_page_defaults

LINK_TYPE = "array<struct<href:string,text:string,nofollow:boolean>>"

_CONTENT_ZONE = "(?:" + "|".join((
    r"<(?i:main|article)(?=[\s/>])",
    H.tag_with("role", value="main"),
    H.tag_with("id", value="content"),
    H.tag_with("class", token="(?:content|post-content|entry-content|page-content)"),
)) + ")"
_NAV_ZONE = (
    r"(?is)<header(?:[\s/][^>]*)?>.*?</header\s*>|<nav(?:[\s/][^>]*)?>.*?</nav\s*>"
)
_ROLE_NAV = H.tag_with("role", value="navigation")
_FAQ_WORDS = r"(?i)(?:^|[^A-Za-z0-9_])(?:faq|frequently|question)|[A-Za-z0-9_](?:คำถาม|ถามตอบ)"
_TOC_MARKUP = (
    H.tag_with("class", part="(?:toc|table-of-content)"), H.tag_with("id", part="toc"),
)
_AUTHOR_MARKUP = (
    H.tag_with("class", part="author"), H.tag_with("rel", value="author"),
    H.tag_with("itemprop", value="author"),
)
_DATE_MARKUP = (
    H.tag_with("class", part="date"), r"(?i)<time[\s/>]",
    H.tag_with("itemprop", value="datePublished"),
)
_CTA_MARKUP = (r"(?i)<button[\s/>]", H.tag_with("class", part="(?:btn|cta|buy|order)", name="a"))


def _links(pieces: Column, base: Column) -> Column:
    """Anchors as (href, text, nofollow, internal): dead ones left out, hrefs made absolute."""

    def parts(p: Column) -> Column:
        return let(
            F.regexp_extract(p, H.ANCHOR_HEAD, 1),
            lambda head: F.struct(
                H.attr(head, "href").alias("href"),
                H.anchor_text(p).alias("text"),
                H.attr(head, "rel").contains("nofollow").alias("nofollow"),
            ),
        )

    def located(x: Column) -> Column:
        return F.struct(
            U.resolve(x["href"], base).alias("href"),
            x["text"].alias("text"),
            x["nofollow"].alias("nofollow"),
        )

    def placed(x: Column) -> Column:
        inside = let(
            F.coalesce(U.host(x["href"]), F.lit("")),
            lambda h: (h == base["host"]) | h.endswith(F.concat(F.lit("."), base["host"])),
        )
        return F.struct(
            x["href"].alias("href"), x["text"].alias("text"), x["nofollow"].alias("nofollow"),
            inside.alias("internal"),
        )

    useful = F.filter(
        F.transform(pieces, parts),
        lambda x: (x["href"] != "") & ~x["href"].rlike("^(?:#|mailto:|tel:)"),
    )
    absolute = F.filter(F.transform(useful, located), lambda x: x["href"].isNotNull())
    return F.transform(absolute, placed)


def _side(links: str, internal: bool) -> Column:
    wanted = F.filter(links, lambda x: x["internal"] == F.lit(internal))
    return F.transform(
        wanted,
        lambda x: F.struct(
            x["href"].alias("href"), x["text"].alias("text"), x["nofollow"].alias("nofollow")
        ),
    )


def schema_nodes(blocks: Column) -> Column:
    """Structured-data blocks as (type, raw) in reading order, `@graph` within `@graph` to any depth."""
    parse = "`@type` STRING, `@graph` ARRAY<STRING>"

    def node(raw: Column) -> Column:
        def read(d: Column) -> Column:
            kind = F.when(
                d["@type"].startswith("["), F.regexp_replace(d["@type"], r'[\[\]"]', "")
            ).otherwise(d["@type"])
            return F.struct(kind.alias("type"), raw.alias("raw"), d["@graph"].alias("graph"))

        return let(F.from_json(raw, parse), read)

    def expand(nodes: Column) -> Column:
        own = lambda n: F.array(
            F.struct(n["type"].alias("type"), n["raw"].alias("raw"),
                     F.lit(None).cast("array<string>").alias("graph"))
        )
        children = lambda n: F.transform(
            F.coalesce(n["graph"], F.array().cast("array<string>")), node
        )
        return F.flatten(F.transform(nodes, lambda n: F.concat(own(n), children(n))))

    # no block is nested deeper than it has graphs; a key written with escapes still has its bracket
    text = F.array_join(blocks, " ")
    graphs = F.size(F.split(text, F.when(text.contains("\\u00"), "\\[").otherwise('"@graph"'))) - 1
    rounds = F.when(graphs > 0, F.sequence(F.lit(1), graphs)).otherwise(F.array().cast("array<int>"))
    found = F.aggregate(rounds, F.transform(blocks, node), lambda nodes, _: F.when(
        F.exists(nodes, lambda n: F.size(n["graph"]) > 0), expand(nodes)).otherwise(nodes))
    named = F.filter(found, lambda n: F.coalesce(n["type"], F.lit("")) != "")
    return F.transform(
        named, lambda n: F.struct(n["type"].alias("type"), n["raw"].alias("raw"))
    )


def brand_colors(html: Column) -> Column:
    """Mid-tone hex colours of CSS variables and backgrounds, in order of sight."""
    variables = F.regexp_extract_all(
        html, F.lit(r"(?i)--[a-z-]*color[a-z-]*:\s*(#[0-9a-fA-F]{3,8}|rgb[^;]+)"), F.lit(1)
    )
    backgrounds = F.regexp_extract_all(
        html, F.lit(r"(?i)background(?:-color)?:\s*(#[0-9a-fA-F]{6})"), F.lit(1)
    )
    distinct = F.array_distinct(F.transform(F.concat(variables, backgrounds), trim_ws))

    def channel(c: Column, at: int) -> Column:
        return F.conv(F.substring(c, at, 2), 16, 10).cast("int")

    def mid_tone(c: Column) -> Column:
        return let(channel(c, 2) + channel(c, 4) + channel(c, 6), lambda v: (v > 60) & (v < 690))

    return F.filter(distinct, lambda c: c.startswith("#") & (F.length(c) >= 7) & mid_tone(c))


def title_keywords(title: Column) -> Column:
    parts = F.split(F.lower(title), r"[\s|,\-–—:]+")
    clean = F.transform(parts, lambda w: F.regexp_replace(w, "[^a-z0-9ก-๙]", ""))
    return F.filter(clean, lambda w: F.length(w) >= 3)


def headings(h: Column, level: int) -> Column:
    found = F.regexp_extract_all(h, F.lit(H.element(f"h{level}")), F.lit(1))
    return F.filter(F.transform(found, markup_text), lambda t: t != "")


def _schema_flag(*parts: str) -> Column:
    test = "|".join(parts)
    return F.exists("schemas", lambda s: F.lower(s["type"]).rlike(test))


def page_features(pages: DataFrame, *, strict: bool = False, bare_references: bool = True) -> DataFrame:
    """Features of every page of a page table (`page_id, url, html[, status, fetch_ms, …]`).

    A page that could not be fetched (null or empty html) keeps its row, with defaults.
    `strict` selects the literal page-type rule, see `urls.page_type`.  `&quot` and the like are
    read without a semicolon, as browsers do, unless `bare_references` is false.
    """
    c = F.col
    df = with_page_defaults(pages).withColumn("html", F.nullif(c("html"), F.lit("")))
    kept = H.strip_noise(c("html"))
    df = df.withColumns({
        "_h": kept if bare_references else H.bare_references_as_text(kept),
        "_host": U.host(c("url")),
        "_base": U.base_parts(c("url")),
        "_schemas": schema_nodes(H.json_ld_blocks(c("html"))),
        "brand_colors": brand_colors(c("html")),
    })
    df = df.withColumn("_t", H.tag_text(c("_h")))
    df = df.withColumns({
        "title": null_if_blank(
            trim_ws(decode_entities(F.regexp_extract("_h", H.element("title"), 1)))),
        "_metas": H.tags(c("_t"), "meta"),
        "_link_tags": H.tags(c("_t"), "link"),
        "_imgs": H.tags(c("_t"), "img"),
        "h1": null_if_blank(markup_text(F.regexp_extract("_h", H.element("h1"), 1))),
        "h1_count": H.count_tags(c("_t"), "h1"),
        "h2s": headings(c("_h"), 2),
        "h3s": headings(c("_h"), 3),
        "schemas": c("_schemas"),
        "_zone": H.first_inner(c("_h"), _CONTENT_ZONE),
        "_body": H.body_markup(c("_h")),
        "_links": _links(H.anchor_pieces(c("_h")), c("_base")),
        "_nav_zones": F.regexp_extract_all("_h", F.lit(_NAV_ZONE), F.lit(0)),
        "_role_nav": F.when(c("_t").contains("navigation"), H.first_inner(c("_h"), _ROLE_NAV)),
        "paragraph_count": H.count_tags(c("_t"), "p"),
        "_ordered_lists": F.regexp_extract_all("_h", F.lit(H.element("ol")), F.lit(1)),
    })
    df = df.withColumns({
        "_content": F.when(c("_zone").isNotNull(), markup_text(c("_zone"))).otherwise(
            collapse_ws(F.array_join(
                F.transform(
                    H.paragraphs(c("_h")),
                    lambda p: decode_entities(F.regexp_replace(p, r"<[^>]*>", "")),
                ), " "))),
        "canonical": null_if_blank(trim_ws(H.attr(
            F.get(F.filter("_link_tags", lambda t: t.rlike(
                H.tag_with("rel", value="canonical", name="link"))), F.lit(0)), "href"))),
        "meta_description": H.meta_content(c("_metas"), "name", "description"),
        "meta_robots": H.meta_content(c("_metas"), "name", "robots"),
        "viewport": H.meta_content(c("_metas"), "name", "viewport").isNotNull(),
        "og_title": H.meta_content(c("_metas"), "property", "og:title"),
        "og_description": H.meta_content(c("_metas"), "property", "og:description"),
        "og_image": H.meta_content(c("_metas"), "property", "og:image"),
        "hreflang": F.filter(
            F.transform(
                F.filter("_link_tags", lambda t: t.rlike(
                    H.tag_with("rel", value="alternate", name="link"))),
                lambda t: F.struct(
                    H.attr(t, "hreflang").alias("lang"), H.attr(t, "href").alias("href")),
            ),
            lambda x: (x["lang"] != "") & (x["href"] != ""),
        ),
        "image_count": F.size("_imgs"),
        "missing_alt_count": F.size(F.filter("_imgs", lambda t: H.attr(t, "alt") == "")),
        "internal_links": _side("_links", True),
        "external_links": _side("_links", False),
        "nav_items": F.array_distinct(F.filter(
                F.transform(
                    F.flatten(F.transform(
                        F.concat(
                            c("_nav_zones"),
                            F.array_compact(F.array(c("_role_nav")))),
                        H.anchor_pieces)),
                    H.anchor_text,
                ),
                lambda t: (t != "") & (F.length(t) < 60),
            )),
        "_list_items": F.aggregate(
            "_ordered_lists", F.lit(0), lambda n, z: n + H.count_tags(z, "li")),
        "page_type": F.when(c("html").isNotNull(), U.page_type(c("url"), strict=strict)),
    })
    df = df.withColumn(
        "_text",
        F.when(F.length("_content") > 50, c("_content")).otherwise(markup_text(c("_body"))),
    )
    df = df.withColumns({
        "word_count": count_words(c("_text"), 2),
        "body_snippet": F.substring("_text", 1, 2000),  # for readers; nothing is computed from it
        "has_thai_text": c("_text").rlike("[฀-๿]"),
        "has_latin_text": c("_text").rlike("[a-zA-Z]{3,}"),
        "has_contact_info": contains_any(F.lower("_text"), fv.CONTACT_WORDS)
        | c("_text").rlike(fv.CONTACT_NUMBER_PATTERN),
        "has_faq": c("url").rlike(_FAQ_WORDS)
        | F.coalesce(c("title"), F.lit("")).rlike(_FAQ_WORDS)
        | c("_t").rlike(H.tag_with("class", part="faq"))
        | c("_t").rlike(H.tag_with("id", part="faq"))
        | (H.count_tags(c("_t"), "details") > 3),
        "has_author": any_rlike(c("_t"), _AUTHOR_MARKUP),
        "has_date": any_rlike(c("_t"), _DATE_MARKUP),
        "has_cta_button": any_rlike(c("_t"), _CTA_MARKUP),
        "has_table_of_contents": any_rlike(c("_t"), _TOC_MARKUP)
        | c("_text").rlike(r"(?i)สารบัญ|table of content"),
        "has_numbered_list": c("_list_items") > 2,
        "has_table": c("_t").rlike(r"(?i)<table[\s/>]"),
        "broken_nav_items": F.filter(
            "nav_items", lambda t: any_rlike(t, fv.BROKEN_NAV_PATTERNS)),
        "title_keywords": title_keywords(c("title")),
        "canonical_is_self": c("canonical").isNull()
        | (c("canonical") == c("url"))
        | F.coalesce(U.path(c("canonical")) == U.path(c("url")), F.lit(False)),
        "canonical_mismatch": U.bare_host(U.host(c("canonical"))) != U.bare_host(c("_host")),
        "has_organization_schema": _schema_flag("organization"),
        "has_product_schema": _schema_flag("product"),
        "has_faq_schema": _schema_flag("faq"),
        "has_breadcrumb_schema": _schema_flag("breadcrumb"),
        "has_article_schema": _schema_flag("article", "blogpost"),
        "has_website_schema": _schema_flag("website"),
    })

    def text(name):
        return c(name)

    def number(name, expr=None):
        return F.coalesce(c(name) if expr is None else expr, F.lit(0)).cast("int").alias(name)

    def flag(name, expr=None, default=False):
        return F.coalesce(c(name) if expr is None else expr, F.lit(default)).alias(name)

    def strings(name):
        return F.coalesce(c(name), F.array().cast("array<string>")).alias(name)

    def links(name):
        return F.coalesce(c(name), F.array().cast(LINK_TYPE)).alias(name)

    return df.select(
        "page_id", "url", U.site(c("url")).alias("site"), "status", "fetch_ms", "final_url",
        "fetch_error",
        text("title"), number("title_length", F.length("title")),
        text("meta_description"), number("meta_description_length", F.length("meta_description")),
        text("meta_robots"), text("canonical"),
        F.coalesce(c("hreflang"), F.array().cast("array<struct<lang:string,href:string>>"))
        .alias("hreflang"),
        text("og_title"), text("og_description"), text("og_image"), flag("viewport"),
        text("h1"), number("h1_count"), strings("h2s"), strings("h3s"),
        number("h2_count", F.size("h2s")), number("h3_count", F.size("h3s")),
        flag("has_multiple_h1", c("h1_count") > 1),
        flag("heading_hierarchy_ok",
             (c("h1_count") == 1) & ((F.size("h2s") > 0) | (F.size("h3s") == 0))),
        number("word_count"), number("paragraph_count"),
        flag("has_author"), flag("has_date"),
        flag("has_faq", F.when(c("html").isNotNull(), c("has_faq"))),
        flag("has_contact_info"), flag("has_cta_button"),
        F.coalesce(c("schemas"), F.array().cast("array<struct<type:string,raw:string>>"))
        .alias("schemas"),
        flag("has_organization_schema"), flag("has_product_schema"), flag("has_faq_schema"),
        flag("has_breadcrumb_schema"), flag("has_article_schema"), flag("has_website_schema"),
        number("image_count"), number("missing_alt_count"),
        number("images_with_alt", c("image_count") - c("missing_alt_count")),
        links("internal_links"), links("external_links"),
        number("internal_link_count", F.size("internal_links")),
        number("external_nofollow_count",
               F.size(F.filter("external_links", lambda x: x["nofollow"]))),
        number("external_dofollow_count",
               F.size(F.filter("external_links", lambda x: ~x["nofollow"]))),
        strings("nav_items"), strings("broken_nav_items"), strings("brand_colors"),
        F.coalesce(c("page_type"), F.lit("other")).alias("page_type"),
        flag("canonical_is_self", default=True), flag("canonical_mismatch"),
        flag("is_noindex", c("meta_robots").rlike("(?i)noindex")),
        flag("is_nofollow", c("meta_robots").rlike("(?i)nofollow")),
        flag("has_og_title", c("og_title").isNotNull()),
        flag("has_og_description", c("og_description").isNotNull()),
        flag("has_og_image", c("og_image").isNotNull()),
        strings("title_keywords"),
        flag("has_table_of_contents"), flag("has_numbered_list"), flag("has_table"),
        flag("has_thai_text"), flag("has_latin_text"),
        F.coalesce(c("body_snippet"), F.lit("")).alias("body_snippet"),
    )


def page_links(features: DataFrame) -> DataFrame:
    """One row per link of a page, internal before external, in reading order."""
    both = F.concat(
        F.transform("internal_links", lambda x: F.struct(
            F.lit(True).alias("is_internal"), x["href"].alias("href"), x["text"].alias("text"),
            x["nofollow"].alias("nofollow"))),
        F.transform("external_links", lambda x: F.struct(
            F.lit(False).alias("is_internal"), x["href"].alias("href"), x["text"].alias("text"),
            x["nofollow"].alias("nofollow"))),
    )
    return features.select(
        "page_id", "site", "url", F.posexplode(both).alias("pos", "link")
    ).select("page_id", "site", "url", "pos", "link.*")
