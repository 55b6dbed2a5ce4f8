"""Per-site facts, scores, strengths and the recommended sitemap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright import fixed_values as fv
from sitewright.functions import urls as U
from sitewright.functions.ranking import collect_ranked, top_k
from sitewright.functions.text import compact, keep


def ok_page() -> Column:
    return F.expr("status = 200")


def live_page() -> Column:
    return F.expr("status = 200 OR status IS NULL")


def ok_pages(features: DataFrame) -> DataFrame:
    return features.filter("status = 200")


def live_pages(features: DataFrame) -> DataFrame:
    return features.filter("status = 200 OR status IS NULL")


def broken_pages(features: DataFrame) -> DataFrame:
    return features.filter("status >= 400")


def discovered_urls(features: DataFrame, sitemap_urls: DataFrame | None = None) -> DataFrame:
    """Distinct URLs per site: those of the sitemap and those crawled."""
    crawled = features.select("site", "url")
    both = crawled if sitemap_urls is None else crawled.unionByName(
        sitemap_urls.select("site", "url"))
    return both.distinct()


def crawl_queue(features: DataFrame, sitemap_urls: DataFrame | None = None) -> DataFrame:
    """URLs to fetch per site: the sitemap, and links of the home page to its own host."""
    home = features.filter("page_type = 'home'").select(
        "site", U.host(F.col("url")).alias("own_host"), F.explode("internal_links.href").alias("url"))
    links = home.filter(U.host(F.col("url")) == F.col("own_host")).select("site", "url")
    both = links if sitemap_urls is None else links.unionByName(sitemap_urls.select("site", "url"))
    return both.distinct()


def title_groups(features: DataFrame) -> DataFrame:
    """How often each title is used on a site."""
    return features.filter("title IS NOT NULL").groupBy("site", "title").agg(
        F.count("*").alias("n_pages"),
        F.count_if(ok_page()).alias("n_ok"),
        F.count_if(live_page()).alias("n_live"),
        F.min(F.when(live_page(), F.col("page_id"))).alias("first_page_id"),
    )


def site_languages(features: DataFrame) -> DataFrame:
    """Distinct language tags per site: hreflang, else what the text is written in."""
    tagged = features.select("site", F.explode("hreflang.lang").alias("lang")).distinct()
    text = features.groupBy("site").agg(
        F.bool_or("has_thai_text").alias("th"),
        F.bool_or("has_latin_text").alias("en"),
    ).join(tagged.select("site").distinct(), "site", "left_anti")
    seen = text.select("site", F.explode(compact(
        keep(F.col("th"), "th"), keep(F.col("en"), "en"))).alias("lang"))
    return tagged.unionByName(seen)


def _language_columns(features: DataFrame) -> DataFrame:
    return features.select("site", F.explode("hreflang.lang").alias("lang")).distinct().groupBy(
        "site").agg(F.sort_array(F.collect_set("lang")).alias("_tagged"))


def _n(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _page_counts(features: DataFrame) -> DataFrame:
    """Every count, sum and first page that scores, issues and summaries need, in one pass."""
    c = F.col
    ok, live = ok_page(), live_page()
    kind = c("page_type")
    no_og = ~c("has_og_title") | ~c("has_og_image")
    no_schema = F.size("schemas") == 0
    key_type = kind.isin("home", "product", "category", "blog")
    counts = {
        "n_pages": F.count("*"),
        "n_ok": _n(ok),
        "n_live": _n(live),
        # all pages
        "broken": _n(c("status") >= 400),
        "no_canonical": _n(c("canonical").isNull()),
        "mismatch": _n(c("canonical_mismatch")),
        "noindex_key": _n(c("is_noindex") & key_type),
        "fetch_ms_mean": F.avg("fetch_ms"),
        "products_all": _n(kind == "product"),
        "text_th": F.bool_or("has_thai_text"),
        "text_en": F.bool_or("has_latin_text"),
        # pages with status 200
        "ok_titled": _n(ok & c("title").isNotNull()),
        "ok_no_title": _n(ok & c("title").isNull()),
        "ok_no_meta": _n(ok & c("meta_description").isNull()),
        "ok_no_h1": _n(ok & c("h1").isNull()),
        "ok_hreflang": _n(ok & (F.size("hreflang") > 0)),
        "ok_no_og": _n(ok & no_og),
        "ok_multi_h1": _n(ok & c("has_multiple_h1")),
        "ok_no_breadcrumb": _n(ok & ~c("has_breadcrumb_schema")),
        "ok_few_links": _n(ok & (c("internal_link_count") < 3)),
        "ok_no_cta": _n(ok & ~c("has_cta_button")),
        "ok_no_viewport": _n(ok & ~c("viewport")),
        "ok_missing_alt": _n(ok & (c("missing_alt_count") > 0)),
        "ok_no_contact_key": _n(ok & ~c("has_contact_info") & kind.isin("home", "contact")),
        "ok_thin": _n(ok & (c("word_count") < 300)),
        "ok_no_schema": _n(ok & no_schema),
        "ok_products": _n(ok & (kind == "product")),
        "ok_short_product_titles": _n(ok & (kind == "product") & (F.length("title") < 20)),
        "ok_faq": _n(ok & (c("has_faq") | (kind == "faq"))),
        "ok_faq_pages": _n(ok & (kind == "faq")),
        "ok_blogs": _n(ok & (kind == "blog")),
        "ok_blogs_no_author": _n(ok & (kind == "blog") & ~c("has_author")),
        "ok_services": _n(ok & (kind == "service")),
        "ok_collections": _n(ok & kind.isin("category", "collection")),
        "ok_contact": _n(ok & c("has_contact_info")),
        "ok_slow": _n(ok & (c("fetch_ms") > 2000)),
        "ok_fetch_ms": F.sum(F.when(ok, c("fetch_ms"))),
        "ok_noindex": _n(ok & c("is_noindex")),
        "ok_org": _n(ok & c("has_organization_schema")),
        "ok_product_schema": _n(ok & c("has_product_schema")),
        "ok_breadcrumb": _n(ok & c("has_breadcrumb_schema")),
        "ok_faq_schema": _n(ok & c("has_faq_schema")),
        "ok_article_schema": _n(ok & c("has_article_schema")),
        # pages with status 200 or none
        "no_title": _n(live & c("title").isNull()),
        "no_meta": _n(live & c("meta_description").isNull()),
        "no_h1": _n(live & c("h1").isNull()),
        "weak_h1": _n(live & (F.length("h1") < 15)),
        "no_schema": _n(live & no_schema),
        "no_schema_no_breadcrumb": _n(live & no_schema & ~c("has_breadcrumb_schema")),
        "products": _n(live & (kind == "product")),
        "code_titles": _n(live & (kind == "product")
                          & (F.length(F.regexp_replace("title", "[^a-zA-Z0-9]", "")) < 15)),
        "thin": _n(live & (c("word_count") < 300)),
        "words": F.sum(F.when(live, c("word_count"))),
        "no_hreflang": _n(live & (F.size("hreflang") == 0)),
        "no_breadcrumb": _n(live & ~c("has_breadcrumb_schema")
                            & kind.isin("product", "category", "collection", "blog")),
        "missing_alt": _n(live & (c("missing_alt_count") > 0)),
        "no_cta": _n(live & ~c("has_cta_button") & (kind != "policy")),
        "few_links": _n(live & (c("internal_link_count") < 3)),
        "noindex": _n(live & c("is_noindex")),
        "noindex_important": _n(live & c("is_noindex")
                                & kind.isin("home", "product", "category", "collection", "blog")),
        "multi_h1": _n(live & c("has_multiple_h1")),
        "bad_hierarchy": _n(live & c("h1").isNotNull() & (c("h3_count") > 0)
                            & (c("h2_count") == 0)),
        "no_og": _n(live & no_og),
        "live_mismatch": _n(live & c("canonical_mismatch")),
        "no_canonical_typed": _n(live & c("canonical").isNull() & (kind != "other")),
        "slow": _n(live & (c("fetch_ms") > 3000)),
        "live_fetch_ms": F.sum(F.when(live, c("fetch_ms"))),
        "no_h2": _n(live & kind.isin("home", "product", "category", "blog", "service")
                    & (c("h2_count") == 0) & (c("word_count") > 200)),
        # whether the first page of a kind carries its structured data
        "home_org": F.min_by("has_organization_schema",
                             F.when(live & (kind == "home"), c("page_id"))),
        "product_schema": F.min_by("has_product_schema",
                                   F.when(live & (kind == "product"), c("page_id"))),
        "faq_schema": F.min_by(
            "has_faq_schema",
            F.when(live & (c("has_faq") | (kind == "faq")), c("page_id"))),
    }
    return features.groupBy("site").agg(*[e.alias(n) for n, e in counts.items()])


def _first_pages(features: DataFrame) -> DataFrame:
    """Texts of the first page and of the home page of a site.

    Kept apart from the counts: text in an aggregation buffer forces a sort-based aggregate, which
    here sorts a few columns only, while the counts stay in a hash aggregate.
    """
    c = F.col
    return features.groupBy("site").agg(
        F.min_by(F.struct("url", "brand_colors"), "page_id").alias("first"),
        F.min_by(
            F.struct("url", "title", "nav_items"),
            F.when(c("page_type") == "home", c("page_id"))).alias("home"))


def site_facts(features: DataFrame, *, sitemaps: DataFrame | None = None,
               robots: DataFrame | None = None, sitemap_urls: DataFrame | None = None,
               discovered: DataFrame | None = None) -> DataFrame:
    """One row of facts per site.

    `features` comes from `page_features`; hand in a stored table, it is read five times.
    `sitemaps` and `robots` are the per-site tables of `sources.sitemaps`; without them a site has
    neither.  `discovered` are the URLs (`site, url`) to count, each row once; unless handed in,
    those of `discovered_urls`.  Every part is hashed by site already, so the joins add no shuffle
    of their own.
    """
    c = F.col
    found = (discovered_urls(features, sitemap_urls) if discovered is None else discovered).groupBy("site").agg(
        F.count("*").alias("n_discovered"),
        F.count_if(U.depth(U.path(c("url"))) > 4).alias("n_deep"),
    )
    titles = title_groups(features).groupBy("site").agg(
        F.count_if(c("n_ok") > 0).alias("ok_titles"),
        F.count_if(c("n_live") > 1).alias("duplicate_titles"),
    )
    df = _page_counts(features).join(_first_pages(features), "site").join(found, "site", "left").join(titles, "site", "left").join(
        _language_columns(features), "site", "left")
    if sitemaps is None:
        df = df.withColumns({
            "sitemap_found": F.lit(False), "sitemap_url": F.lit(None).cast("string"),
            "sitemap_status": F.lit(None).cast("int"), "sitemap_url_count": F.lit(0).cast("bigint"),
        })
    else:
        df = df.join(
            sitemaps.select("site", "sitemap_found", "sitemap_url", "sitemap_status",
                            "sitemap_url_count"), "site", "left")
    if robots is None:
        df = df.withColumns({
            "robots_found": F.lit(False), "sitemap_declared": F.lit(False),
            "disallowed_paths": F.array().cast("array<string>"),
        })
    else:
        df = df.join(robots.select("site", "robots_found", "sitemap_declared", "disallowed_paths"),
                     "site", "left")
    base = F.coalesce(c("home")["url"], c("first")["url"])
    nav = F.coalesce(c("home")["nav_items"], F.array().cast("array<string>"))
    df = df.withColumns({
        "base_url": U.origin(base),
        "is_https": F.coalesce(F.lower(base).startswith("https"), F.lit(False)),
        "nav_items": nav,
        "brand_colors": c("first")["brand_colors"],
        "home_url": c("home")["url"],
        "home_title": c("home")["title"],
        "languages": F.coalesce(
            c("_tagged"), compact(keep(c("text_en"), "en"), keep(c("text_th"), "th"))),
        "sitemap_found": F.coalesce("sitemap_found", F.lit(False)),
        "sitemap_url_count": F.coalesce("sitemap_url_count", F.lit(0)),
        "robots_found": F.coalesce("robots_found", F.lit(False)),
        "sitemap_declared": F.coalesce("sitemap_declared", F.lit(False)),
        "ok_titles": F.coalesce("ok_titles", F.lit(0)),
        "duplicate_titles": F.coalesce("duplicate_titles", F.lit(0)),
        "nav_raw": F.size(F.filter(nav, lambda t: t.rlike(fv.RAW_VARIABLE_PATTERN))),
        "nav_broken": F.filter(
            nav, lambda t: t.rlike(fv.BROKEN_NAV_ISSUE_PATTERNS[0])
            | t.rlike(fv.BROKEN_NAV_ISSUE_PATTERNS[1])),
    })
    return df.withColumn("is_multi_language", F.size("languages") > 1).drop(
        "_tagged", "home", "first", "text_th", "text_en")


def _clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(10), F.round(score))).cast("int")


def _off(cond: Column, points) -> Column:
    return F.when(cond, points if isinstance(points, Column) else F.lit(points)).otherwise(F.lit(0))


def _few(n: Column, most: int) -> Column:
    return F.least(F.lit(most), n)


def site_scores(facts: DataFrame) -> DataFrame:
    """Five scores out of ten and their weighted mean, one row per site."""
    c = F.col
    ok, titled = c("n_ok"), c("ok_titled")
    technical = (
        F.lit(10) - _off(~c("sitemap_found"), 3) - _off(~c("robots_found"), 2)
        - _off(~c("is_https"), 3) - _few(c("broken"), 2)
        - _off(c("no_canonical") > c("n_pages") * 0.5, 1)
        - _few(c("mismatch"), 2) - _few(c("noindex_key"), 2)
        - F.when(c("fetch_ms_mean") > 5000, 2).when(c("fetch_ms_mean") > 3000, 1).otherwise(0)
    )
    onpage = (
        F.lit(10) - _off(c("ok_no_title") / ok > 0.1, 2) - _off(c("ok_no_meta") / ok > 0.2, 2)
        - _off(c("ok_no_h1") / ok > 0.1, 2) - _off(c("ok_titles") < titled * 0.8, 2)
        - _off(c("is_multi_language") & (c("ok_hreflang") < ok * 0.5), 1)
        - _off(c("ok_no_og") / ok > 0.6, 1) - _off(c("ok_multi_h1") / ok > 0.2, 1)
    )
    structure = (
        F.lit(10) - _off(~c("sitemap_found"), 2) - _off(c("ok_no_breadcrumb") > ok * 0.7, 2)
        - _off(c("ok_few_links") > ok * 0.5, 2) - _off(c("n_deep") > c("n_discovered") * 0.3, 1)
        - _off(c("nav_raw") > 0, 1) - _few(c("broken"), 2)
    )
    ux = (
        F.lit(10) - _off(c("ok_no_cta") > ok * 0.5, 2) - _few(c("ok_no_viewport"), 3)
        - _off(c("ok_missing_alt") > ok * 0.4, 1) - _off(c("nav_raw") > 0, 2)
        - _off(c("ok_no_contact_key") > 0, 1)
    )
    content = (
        F.lit(10)
        - F.when(c("ok_thin") > ok * 0.5, 3).when(c("ok_thin") > ok * 0.2, 1).otherwise(0)
        - _off(c("ok_no_schema") > ok * 0.7, 2)
        - _off(c("ok_short_product_titles") > c("ok_products") * 0.5, 2)
        - _off(c("ok_faq") == 0, 1)
        - _off((c("ok_blogs") > 0) & (c("ok_blogs_no_author") > c("ok_blogs") * 0.5), 1)
    )
    df = facts.select(
        "site",
        _clamp(technical).alias("technical"),
        F.when(ok == 0, 5).otherwise(_clamp(onpage)).alias("onpage"),
        _clamp(structure).alias("site_structure"),
        _clamp(ux).alias("ux_ui"),
        F.when(ok == 0, 5).otherwise(_clamp(content)).alias("content_quality"),
    )
    overall = (
        c("technical") * 0.25 + c("onpage") * 0.25 + c("site_structure") * 0.15
        + c("ux_ui") * 0.15 + c("content_quality") * 0.20
    )
    return df.withColumn("overall", _clamp(overall))


def score_grade(score: Column) -> Column:
    return (
        F.when(score >= 8, "A").when(score >= 6, "B").when(score >= 4, "C")
        .when(score >= 2, "D").otherwise("F")
    )


def site_strengths(facts: DataFrame, *, strict: bool = False) -> DataFrame:
    """What a site does well: (id, detail) in fixed order, with a fallback row.

    `strict` keeps the literal rule by which collections are never counted.
    """
    c = F.col
    ok = c("n_ok")

    def row(cond: Column, name: str, detail: Column | None = None) -> Column:
        d = F.lit(None).cast("string") if detail is None else detail.cast("string")
        return keep(cond, F.struct(F.lit(name).alias("id"), d.alias("detail")))

    with_schema, with_meta = ok - c("ok_no_schema"), ok - c("ok_no_meta")
    collections = F.lit(0) if strict else c("ok_collections")
    found = compact(
        row(c("is_https"), "https"),
        row(c("sitemap_found"), "sitemap", c("sitemap_url_count")),
        row(c("robots_found"), "robots"),
        row(c("is_multi_language"), "languages", F.array_join("languages", ", ")),
        row(with_schema > ok * 0.3, "schema", with_schema),
        row(c("ok_faq") > 0, "faq"),
        row(with_meta > ok * 0.7, "meta_descriptions", with_meta),
        row(c("ok_products") > 5, "products", c("ok_products")),
        row(collections > 3, "collections", collections),
        row(c("ok_contact") > ok * 0.5, "contact_info"),
    )
    fallback = F.array(F.struct(
        F.lit("online").alias("id"), F.lit(None).cast("string").alias("detail")))
    return facts.select(
        "site", F.when(F.size(found) > 0, found).otherwise(fallback).alias("strengths"))


def content_audit(facts: DataFrame, features: DataFrame) -> DataFrame:
    """Content signals of pages with status 200, with the first slow and noindex pages."""
    c = F.col
    pages = ok_pages(features)
    slow = collect_ranked(
        top_k(pages.filter("fetch_ms > 2000").select("site", "page_id", "url", "fetch_ms"),
              ["site"], [c("page_id")], 5),
        ["site"], F.struct(c("url"), c("fetch_ms").alias("ms")), "slow_pages")
    hidden = collect_ranked(
        top_k(pages.filter("is_noindex").select("site", "page_id", "url"),
              ["site"], [c("page_id")], 10),
        ["site"], c("url"), "noindex_pages")
    return facts.select(
        "site", (c("ok_blogs") > 0).alias("has_blog"), (c("ok_faq_pages") > 0).alias("has_faq_page"),
        (c("ok_services") > 0).alias("has_service"), c("ok_blogs").alias("blog_count"),
        F.when(c("n_ok") > 0, F.round(c("ok_fetch_ms") / c("n_ok"))).otherwise(0)
        .cast("bigint").alias("avg_fetch_ms"),
        c("ok_no_meta").alias("missing_meta_count"), c("ok_no_h1").alias("missing_h1_count"),
        c("ok_no_og").alias("missing_og_count"),
    ).join(slow, "site", "left").join(hidden, "site", "left").withColumns({
        "slow_pages": F.coalesce("slow_pages", F.array().cast("array<struct<url:string,ms:bigint>>")),
        "noindex_pages": F.coalesce("noindex_pages", F.array().cast("array<string>")),
    })


def schema_coverage(facts: DataFrame) -> DataFrame:
    c = F.col
    return facts.select(
        "site", (c("n_ok") - c("ok_no_schema")).alias("with_any_schema"),
        c("ok_org").alias("with_org"), c("ok_product_schema").alias("with_product"),
        c("ok_breadcrumb").alias("with_breadcrumb"), c("ok_faq_schema").alias("with_faq"),
        c("ok_article_schema").alias("with_article"),
    )


TYPE_COUNT_COLUMNS = (
    "home", "product", "collection", "blog", "service", "faq", "about", "contact", "policy", "other",
)


def page_type_counts(features: DataFrame, *, strict: bool = False) -> DataFrame:
    """Pages with status 200 per type; `category` pages are the collections unless `strict`."""
    kind = F.col("page_type")
    if not strict:
        kind = F.when(kind == "category", "collection").otherwise(kind)
    return ok_pages(features).groupBy("site").agg(
        *[F.count_if(kind == t).alias(t) for t in TYPE_COUNT_COLUMNS])


SITEMAP_CAPS = {"collections": 15, "pages": 10, "blogs": 10, "other": 10}


def recommended_sitemap(features: DataFrame, sitemap_urls: DataFrame | None = None, *,
                        strict: bool = False, caps: dict[str, int] = SITEMAP_CAPS) -> DataFrame:
    """Paths to list in a sitemap, by bucket, the first of each as `caps` says.

    Other pages are those of no bucket: a path that its bucket's list has no room for is not one of them.
    """
    c = F.col
    most = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    kind = c("page_type")
    collection = (kind == "collection") if strict else kind.isin("collection", "category")
    bucket = (
        F.when(collection, "collections")
        .when(kind.isin("faq", "about", "contact", "policy"), "pages")
        .when(kind == "blog", "blogs")
    )
    paths = features.select(
        "site", "page_id", bucket.alias("bucket"),
        F.coalesce(U.path(c("url")), c("url")).alias("path"),
    ).filter("bucket IS NOT NULL").groupBy("site", "bucket", "path").agg(
        F.min("page_id").alias("first_id"))
    capped = top_k(paths, ["site", "bucket"], [c("first_id"), c("path")], max(caps.values())).filter(
        c("rank") <= most[c("bucket")])
    p = U.path(c("url"))
    rest = discovered_urls(features, sitemap_urls).select("site", "url", p.alias("path")).filter(
        (c("path") != "/") & ~c("path").rlike(fv.OTHER_PATH_FILE_PATTERN)
        & ~c("path").rlike(fv.OTHER_PATH_SYSTEM_PATTERN) & (U.depth(c("path")) <= 3)
    ).join(paths.select("site", "path"), ["site", "path"], "left_anti")
    other = top_k(rest, ["site"], [c("url")], caps["other"]).select(
        "site", F.lit("other").alias("bucket"), "path", "rank")
    lists = capped.select("site", "bucket", "path", "rank").unionByName(other)
    grouped = lists.groupBy("site").agg(*[
        F.transform(
            F.sort_array(F.collect_list(F.when(c("bucket") == b, F.struct("rank", "path")))),
            lambda x: x["path"]).alias(b)
        for b in ("collections", "pages", "blogs", "other")
    ])
    sites = features.groupBy("site").agg(F.count_if(kind == "product").alias("n"))
    none = F.array().cast("array<string>")
    return sites.join(grouped, "site", "left").select(
        "site", F.lit("/").alias("home"),
        F.coalesce("collections", none).alias("collections"),
        F.when(c("n") > 0, F.concat(
            F.lit("/products/[product-slug] ("), c("n").cast("string"), F.lit(")")))
        .otherwise("").alias("products"),
        *[F.coalesce(b, none).alias(b) for b in ("pages", "blogs", "other")],
    )


#: Paths of each bucket that a report shows.
REPORT_CAPS = {"collections": 10, "pages": 8, "blogs": 6, "other": 5}


def sitemap_report_total(caps: dict[str, int] = REPORT_CAPS) -> Column:
    """How many entries a report shows of a row of `recommended_sitemap`."""
    total = F.lit(1) + F.when(F.col("products") != "", 1).otherwise(0)
    for name, most in caps.items():
        total = total + F.least(F.size(name), F.lit(most))
    return total


def sitemap_report_groups(recommended: DataFrame, caps: dict[str, int] = REPORT_CAPS) -> DataFrame:
    """Sitemap groups as a report shows them and how many entries there are."""
    return recommended.select(
        "site", "home", "products", *[F.slice(n, 1, most).alias(n) for n, most in caps.items()],
        sitemap_report_total(caps).alias("total_urls"))


def site_summary(facts: DataFrame) -> DataFrame:
    c = F.col
    return facts.select(
        "site", "base_url", "is_https", c("n_pages").alias("page_count"),
        c("n_discovered").alias("discovered_url_count"), "brand_colors",
        "sitemap_found", "sitemap_url", "sitemap_url_count", "sitemap_status", "sitemap_declared",
        "robots_found", "disallowed_paths", "languages", "is_multi_language", "nav_items",
    )
