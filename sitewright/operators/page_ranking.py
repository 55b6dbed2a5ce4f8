"""Which URLs to crawl and which pages to show: ranked and capped lists per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright import fixed_values as fv
from sitewright.functions import urls as U
from sitewright.functions.ranking import top_k
from sitewright.operators.site import live_pages, ok_pages


def sitemap_url_filter(urls: DataFrame) -> DataFrame:
    """URLs of the site itself that are no media or binary files; needs `site, url`."""
    c = F.col
    own = U.site(c("url")) == c("site")
    return urls.filter(own & ~c("url").rlike(fv.SITEMAP_ASSET_PATTERN)).dropDuplicates(
        ["site", "url"])


def crawl_candidates(urls: DataFrame) -> DataFrame:
    """URLs worth fetching: same site, no asset, no tracking parameter."""
    c = F.col
    own = U.site(c("url")) == c("site")
    return urls.filter(
        own & ~c("url").rlike(fv.CRAWL_ASSET_PATTERN) & ~c("url").rlike(fv.TRACKING_PATTERN)
    ).dropDuplicates(["site", "url"])


def crawl_frontier(urls: DataFrame, *, cap: int = fv.CRAWL_FRONTIER_CAP) -> DataFrame:
    """The first 80 candidates of a site by path class and depth."""
    c = F.col
    ranked = crawl_candidates(urls.select("site", "url")).withColumn(
        "priority", U.crawl_priority(c("url")))
    return top_k(ranked, ["site"], [c("priority"), c("url")], cap)


def _position(kind: Column, order, otherwise: int) -> Column:
    out = None
    for i, name in enumerate(order):
        out = F.when(kind == name, i) if out is None else out.when(kind == name, i)
    return out.otherwise(otherwise)


def top_page_weight(kind: Column) -> Column:
    out = None
    for name, weight in fv.TOP_PAGE_WEIGHTS.items():
        out = F.when(kind == name, weight) if out is None else out.when(kind == name, weight)
    return out.otherwise(fv.TOP_PAGE_DEFAULT_WEIGHT)


def _top_order() -> list[Column]:
    return [F.col("weight").desc(), F.col("internal_link_count").desc(),
            F.col("word_count").desc(), F.col("page_id")]


def distinct_looking_pages(features: DataFrame) -> DataFrame:
    """Live pages, at most three with the same type, length and number of links."""
    df = live_pages(features).withColumn("weight", top_page_weight(F.col("page_type")))
    return top_k(df, ["site", "page_type", "word_count", "internal_link_count"],
                 [F.col("page_id")], 3, rank="copy")


def top_pages(features: DataFrame, *, cap: int = 40) -> DataFrame:
    """The 40 most important pages of a site, near-identical ones held to three."""
    narrow = features.select(
        "site", "page_id", "url", "page_type", "title", "h1", "meta_description", "word_count",
        F.transform("schemas", lambda s: s["type"]).alias("schema_types"),
        "internal_link_count", "missing_alt_count", "status")
    ranked = top_k(distinct_looking_pages(narrow), ["site"], _top_order(), cap)
    return ranked.select(
        "site", "rank", "page_id", "url", "page_type", "title", "h1", "meta_description",
        "word_count", "schema_types", "internal_link_count", "missing_alt_count", "status")


def context_pages(features: DataFrame, *, cap: int = 20) -> DataFrame:
    """Pages that describe a site best: by type, then length."""
    c = F.col
    narrow = ok_pages(features).select(
        "site", "page_id", "url", "page_type", "title", "h1", F.slice("h2s", 1, 5).alias("h2s"),
        F.substring("meta_description", 1, 120).alias("meta_description"), "word_count",
        F.transform("schemas", lambda s: s["type"]).alias("schema_types"), "internal_link_count",
        "missing_alt_count", "has_faq", "has_contact_info", "has_organization_schema",
        "has_product_schema", "has_breadcrumb_schema", "canonical", "is_noindex",
        (c("has_og_title") & c("has_og_image")).alias("has_og"),
        _position(c("page_type"), fv.CONTEXT_PAGE_ORDER, len(fv.CONTEXT_PAGE_ORDER) - 1)
        .alias("type_order"))
    return top_k(narrow, ["site"], [c("type_order"), c("word_count").desc(), c("page_id")],
                 cap).drop("type_order")


def verified_urls(features: DataFrame, *, cap: int = 15) -> DataFrame:
    c = F.col
    order = _position(c("page_type"), fv.VERIFIED_URL_ORDER, len(fv.VERIFIED_URL_ORDER) - 1)
    narrow = ok_pages(features).select("site", "page_id", "url", order.alias("type_order"))
    return top_k(narrow, ["site"], [c("type_order"), c("page_id")], cap).select(
        "site", "rank", "url")


def page_title_lines(features: DataFrame, *, cap: int = 100) -> DataFrame:
    """`type|url|title` of the first 100 pages of a site."""
    c = F.col
    narrow = ok_pages(features).select(
        "site", "page_id",
        F.concat_ws("|", "page_type", "url", F.replace(
            F.coalesce("title", F.lit("")), F.lit("|"), F.lit(" "))).alias("line"))
    return top_k(narrow, ["site"], [c("page_id")], cap).select("site", "rank", "line")
