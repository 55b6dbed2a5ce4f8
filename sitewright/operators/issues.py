"""The 24 site issue rules as one long table.

Each rule is a comparison of per-site counts, so firing needs only the facts row of the site.
Examples of the pages behind an issue come from one pass over the pages: a page emits a small row
for each rule it breaks, and only the first few rows per site and rule survive the first step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright import fixed_values as fv
from sitewright.functions import urls as U
from sitewright.functions.ranking import top_k
from sitewright.functions.text import compact, keep
from sitewright.operators.keywords import title_cannibalization
from sitewright.operators.site import title_groups

ITEM_TYPE = (
    "struct<url:string,page:string,label:string,current:string,status:int,value:string,note:string>"
)
FOUND_TYPE = f"array<{ITEM_TYPE}>"
_ITEM_FIELDS = ("url", "page", "label", "current", "status", "value", "note")


def _item(**fields) -> Column:
    """One piece of evidence; fields that are not given are null."""
    parts = []
    for name in _ITEM_FIELDS:
        value = fields.get(name)
        col = value if isinstance(value, Column) else F.lit(value)
        parts.append(col.cast("int" if name == "status" else "string").alias(name))
    return F.struct(*parts)


def _seconds(ms: Column) -> Column:
    return F.format_string("%.1fs", ms / 1000)


def _page_rules() -> list[tuple[str, int, Column, Column]]:
    """(issue, how many examples, page breaks the rule, evidence) over pages with 200 or no status."""
    c = F.col
    kind, url = c("page_type"), c("url")
    live = F.expr("status = 200 OR status IS NULL")
    no_og = ~c("has_og_title") | ~c("has_og_image")
    mark = lambda b: F.when(b, "yes").otherwise("no")
    rules = [
        ("duplicate_missing_title", 3, c("title").isNull(), _item(page=url)),
        ("no_meta_description", 4, c("meta_description").isNull(),
         _item(page=url, value=c("word_count"))),
        ("missing_h1", 4, c("h1").isNull(), _item(page=url)),
        ("weak_h1", 4, F.length("h1") < 15, _item(page=url, current=c("h1"))),
        ("product_title_model_code_only", 4,
         (kind == "product") & (F.length(F.regexp_replace("title", "[^a-zA-Z0-9]", "")) < 15),
         _item(page=url, current=c("title"))),
        ("thin_content", 4, c("word_count") < 300, _item(page=url, value=c("word_count"))),
        ("missing_alt_text", 4, c("missing_alt_count") > 0,
         _item(page=url, value=c("missing_alt_count"))),
        ("no_cta", 3, ~c("has_cta_button") & (kind != "policy"), _item(page=url)),
        ("poor_internal_linking", 4, c("internal_link_count") < 3,
         _item(page=url, value=c("internal_link_count"), note="internal links")),
        ("noindex_pages", 5, c("is_noindex"),
         _item(page=url, current=c("meta_robots"), note=kind)),
        ("multiple_h1", 4, c("has_multiple_h1"),
         _item(page=url, value=c("h1_count"), note="H1 tags")),
        ("heading_hierarchy", 4,
         c("h1").isNotNull() & (c("h3_count") > 0) & (c("h2_count") == 0),
         _item(page=url, current=F.concat(
             F.lit("H1:1, H2:"), c("h2_count").cast("string"),
             F.lit(", H3:"), c("h3_count").cast("string")))),
        ("missing_og_tags", 3, no_og, _item(page=url, note=F.concat(
            F.lit("og:title: "), mark(c("has_og_title")),
            F.lit(" og:image: "), mark(c("has_og_image"))))),
        ("canonical_mismatch", 4, c("canonical_mismatch"),
         _item(page=url, current=c("canonical"))),
        ("missing_canonical", 4, c("canonical").isNull() & (kind != "other"),
         _item(page=url, note=kind)),
        ("slow_server_response", 4, c("fetch_ms") > 3000,
         _item(page=url, value=_seconds(c("fetch_ms")))),
        ("no_h2_structure", 4,
         kind.isin("home", "product", "category", "blog", "service")
         & (c("h2_count") == 0) & (c("word_count") > 200), _item(page=url, note=kind)),
    ]
    rules = [(i, k, F.coalesce(cond, F.lit(False)) & live, item) for i, k, cond, item in rules]
    rules.append(("broken_pages", 5, F.coalesce(c("status") >= 400, F.lit(False)),
                  _item(url=url, status=c("status"))))
    return rules


def issue_examples(features: DataFrame) -> DataFrame:
    """`site, issue_id, found`: the first pages behind every page-level rule, in crawl order."""
    c = F.col
    rules = _page_rules()
    broken = F.array_compact(F.array(*[
        keep(cond, F.struct(F.lit(issue).alias("issue_id"), F.lit(k).alias("most"),
                            item.alias("item")))
        for issue, k, cond, item in rules
    ]))
    rows = features.select("site", "page_id", F.inline(broken))
    kept = top_k(rows, ["site", "issue_id"], [c("page_id")], max(k for _, k, _, _ in rules))
    kept = kept.filter(c("rank") <= c("most"))
    titles = title_groups(features).filter("n_live > 1")
    groups = top_k(titles, ["site"], [c("first_page_id"), c("title")], 3).select(
        "site", F.lit("duplicate_missing_title").alias("issue_id"), (c("rank") + 3).alias("rank"),
        _item(value=c("n_live"), current=c("title")).alias("item"))
    words = title_cannibalization(live_only(features)).select(
        "site", F.lit("keyword_cannibalization").alias("issue_id"), "rank",
        _item(
            label=F.concat(F.lit('"'), c("keyword"), F.lit('"')), value=c("n_occurrences"),
            note=F.array_join(
                F.transform("pages", lambda u: F.coalesce(U.path(u), u)), ", "),
        ).alias("item"))
    every = kept.select("site", "issue_id", "rank", "item").unionByName(groups).unionByName(words)
    return every.groupBy("site", "issue_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]
        ).cast(FOUND_TYPE).alias("found"))


def _site_rules(strict: bool) -> list[dict]:
    """The rules in report order.  `affected` defaults to the count behind `fires`."""
    c = F.col
    n = c("n_live")
    mean_ms = F.when(n > 0, F.round(c("live_fetch_ms") / n)).otherwise(F.lit(0))
    no_pair = ~c("sitemap_found") | ~c("robots_found")
    note = lambda text: F.array(_item(note=text))
    bc = c("no_breadcrumb_strict") if strict else c("no_breadcrumb")

    def rule(issue_id, category, effort, impact, priority, fires, affected, found=None):
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return dict(issue_id=issue_id, category=category, effort=effort, impact=lit(impact),
                    priority=lit(priority), fires=fires, affected=affected, found=found)

    def worse(cond, high, low):
        return F.when(cond, high).otherwise(low)

    missing_schema = compact(
        keep(~c("home_org"), _item(page="Homepage", note="Organization, WebSite")),
        keep(~c("product_schema"),
             _item(page="Product pages", note="Product, Offer, AggregateRating")),
        keep(~c("faq_schema"), _item(page="FAQ page", note="FAQPage")),
        keep(c("no_schema_no_breadcrumb") > 0, _item(page="*", note="BreadcrumbList")),
    )
    root = lambda path, ok: _item(
        url=F.concat("base_url", F.lit(path)), status=F.when(ok, 200).otherwise(404))
    return [
        rule("no_sitemap_robots", "technical", 1.0, fv.IMPACT_VERY_HIGH, "critical", no_pair, n,
             F.array(root("/sitemap.xml", c("sitemap_found")),
                     root("/robots.txt", c("robots_found")))),
        rule("duplicate_missing_title", "onpage", 1.0, fv.IMPACT_VERY_HIGH, "critical",
             (c("no_title") > 0) | (c("duplicate_titles") > 0),
             c("no_title") + c("duplicate_titles")),
        rule("no_meta_description", "onpage", 2.0, fv.IMPACT_HIGH, "critical",
             c("no_meta") > n * 0.15, c("no_meta")),
        rule("missing_h1", "onpage", 1.0, fv.IMPACT_VERY_HIGH,
             worse(c("no_h1") > n * 0.3, "critical", "high"), c("no_h1") > 0, c("no_h1")),
        rule("broken_nav_items", "ux", 0.5, fv.IMPACT_HIGH, "high", F.size("nav_broken") > 0,
             F.size("nav_broken"), F.transform("nav_broken", lambda t: _item(label=t))),
        rule("no_schema_markup", "schema", 5.0, fv.IMPACT_VERY_HIGH, "high",
             c("no_schema") > n * 0.4, c("no_schema"),
             F.when(F.size(missing_schema) > 0, missing_schema)
             .otherwise(F.array(_item(value=c("no_schema"))))),
        rule("weak_h1", "onpage", 1.0, fv.IMPACT_HIGH, "high", c("weak_h1") > 0, c("weak_h1")),
        rule("product_title_model_code_only", "content", 5.0, fv.IMPACT_MEDIUM_HIGH, "high",
             (c("code_titles") > c("products") * 0.3) & (c("code_titles") > 0), c("code_titles")),
        rule("thin_content", "content", 14.0, fv.IMPACT_HIGH, "high", c("thin") > n * 0.3,
             c("thin")),
        rule("broken_pages", "technical", 1.0, fv.IMPACT_VERY_HIGH,
             worse(c("broken") > 3, "critical", "high"), c("broken") > 0, c("broken")),
        rule("missing_hreflang", "technical", 2.0, fv.IMPACT_MEDIUM, "medium",
             c("is_multi_language") & (c("no_hreflang") > n * 0.4), c("no_hreflang"),
             F.array(_item(value=c("no_hreflang"), note=F.array_join("languages", ", ")))),
        rule("no_breadcrumb", "structure", 2.0, fv.IMPACT_MEDIUM, "medium", bc > 0, bc,
             note("Home › All products › Category › Product")),
        rule("missing_alt_text", "content", 3.0, fv.IMPACT_MEDIUM, "medium",
             c("missing_alt") > 0, c("missing_alt")),
        rule("no_cta", "ux", 3.0, fv.IMPACT_MEDIUM, "medium", c("no_cta") > n * 0.4, c("no_cta")),
        rule("poor_internal_linking", "structure", 5.0, fv.IMPACT_MEDIUM, "medium",
             c("few_links") > n * 0.4, c("few_links")),
        rule("noindex_pages", "technical", 1.0,
             worse(c("noindex_important") > 0, fv.IMPACT_VERY_HIGH, fv.IMPACT_MEDIUM),
             worse(c("noindex_important") > 0, "high", "medium"), c("noindex") > 0, c("noindex")),
        rule("multiple_h1", "onpage", 1.0, fv.IMPACT_MEDIUM, "medium", c("multi_h1") > 0,
             c("multi_h1")),
        rule("heading_hierarchy", "onpage", 2.0, fv.IMPACT_MEDIUM, "medium",
             c("bad_hierarchy") > 0, c("bad_hierarchy")),
        rule("missing_og_tags", "onpage", 2.0, fv.IMPACT_MEDIUM, "medium", c("no_og") > n * 0.5,
             c("no_og")),
        rule("canonical_mismatch", "technical", 1.0, fv.IMPACT_VERY_HIGH, "high",
             c("live_mismatch") > 0, c("live_mismatch")),
        rule("missing_canonical", "technical", 2.0, fv.IMPACT_MEDIUM, "medium",
             c("no_canonical_typed") > n * 0.5, c("no_canonical_typed")),
        rule("slow_server_response", "technical", 5.0,
             worse(mean_ms > 5000, fv.IMPACT_HIGH, fv.IMPACT_MEDIUM_HIGH),
             worse(mean_ms > 5000, "high", "medium"),
             (c("slow") > n * 0.3) | (mean_ms > 3000), c("slow")),
        rule("keyword_cannibalization", "content", 7.0, fv.IMPACT_MEDIUM_HIGH, "medium",
             c("repeated_words") > 0, c("repeated_words")),
        rule("no_h2_structure", "content", 3.0, fv.IMPACT_MEDIUM, "medium", c("no_h2") > 2,
             c("no_h2")),
    ]


def site_issues(facts: DataFrame, features: DataFrame, *, strict: bool = False,
                with_examples: bool = True) -> DataFrame:
    """Fired issues of every site: priority, category, size, effort, impact and evidence.

    `position` orders the issues of a site as a report lists them: by priority, then by rule.
    """
    c = F.col
    repeated = title_cannibalization(live_only(features)).groupBy("site").agg(
        F.sum("n_occurrences").alias("repeated_words"))
    df = facts.join(repeated, "site", "left").withColumn(
        "repeated_words", F.coalesce("repeated_words", F.lit(0)))
    if strict:
        literal = features.filter(
            "(status = 200 OR status IS NULL) AND NOT has_breadcrumb_schema"
            " AND page_type IN ('product', 'collection', 'blog')")
        df = df.join(literal.groupBy("site").agg(F.count("*").alias("no_breadcrumb_strict")),
                     "site", "left").fillna(0, ["no_breadcrumb_strict"])
    order = {p: i for i, p in enumerate(fv.PRIORITIES)}
    candidates = [
        keep(F.coalesce(r["fires"], F.lit(False)), F.struct(
            F.lit(at).alias("rule_no"), F.lit(r["issue_id"]).alias("issue_id"),
            r["priority"].alias("priority"), F.lit(r["category"]).alias("category"),
            r["affected"].cast("bigint").alias("affected_count"),
            F.lit(r["effort"]).alias("effort_days"), r["impact"].alias("impact_level"),
            (F.lit(None) if r["found"] is None else r["found"]).cast(FOUND_TYPE).alias("own_found"),
        ))
        for at, r in enumerate(_site_rules(strict), 1)
    ]
    fired = df.select("site", F.inline(F.array_compact(F.array(*candidates))))
    rank = F.lit(len(order))
    for name, i in order.items():
        rank = F.when(c("priority") == name, i).otherwise(rank)
    fired = fired.withColumn("priority_rank", rank)
    if with_examples:
        fired = fired.join(issue_examples(live_or_broken(features)), ["site", "issue_id"], "left")
        fired = fired.withColumn("found", F.coalesce(
            "own_found", "found", F.array().cast(FOUND_TYPE)))
    else:
        fired = fired.withColumn("found", F.coalesce("own_found", F.array().cast(FOUND_TYPE)))
    return fired.select(
        "site", "issue_id", "priority", "priority_rank", "rule_no", "category", "affected_count",
        "effort_days", "impact_level", "found")


def live_only(features: DataFrame) -> DataFrame:
    return features.filter("status = 200 OR status IS NULL")


def live_or_broken(features: DataFrame) -> DataFrame:
    return features.filter("status = 200 OR status IS NULL OR status >= 400")


def issue_counts(issues: DataFrame, strengths: DataFrame) -> DataFrame:
    """How many issues of each priority, and strengths, a site has; every site has a row."""
    counts = issues.groupBy("site").agg(*[
        F.count_if(F.col("priority") == p).alias(p) for p in fv.PRIORITIES])
    return strengths.select("site", F.size("strengths").alias("strengths")).join(
        counts, "site", "left").fillna(0, list(fv.PRIORITIES)).select(
        "site", *fv.PRIORITIES, "strengths")


def evidence_chips(found: Column, *, cap: int = 4, label_chars: int = 60, detail_chars: int = 40) -> Column:
    """The first pieces of evidence as a label and a detail, as short as a row of a report is."""

    def first(*values: Column) -> Column:
        return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))

    def chip(f: Column) -> Column:
        status = F.when(
            f["status"] != 0, F.concat(F.lit("status: "), f["status"].cast("string")))
        value = F.when(f["value"] != "0", f["value"])
        return F.struct(
            F.substring(first(f["url"], f["page"], f["label"], f["note"]), 1, label_chars).alias("label"),
            F.substring(first(f["current"], status, value), 1, detail_chars).alias("detail"),
        )

    return F.transform(F.slice(found, 1, cap), chip)


def issues_with_insights(issues: DataFrame, insights: DataFrame) -> DataFrame:
    """Issue texts, taken from `insights` (`site, issue_id, impact, fix`) where it has any.

    `issues` has `site, issue_id, impact, fix` as arrays of text.
    """
    theirs = insights.select(
        "site", "issue_id", F.col("impact").alias("_impact"), F.col("fix").alias("_fix"))

    def pick(name: str) -> Column:
        other = F.col("_" + name)
        return F.when(F.size(other) > 0, other).otherwise(F.col(name)).alias(name)

    joined = issues.join(theirs, ["site", "issue_id"], "left")
    rest = [n for n in issues.columns if n not in ("impact", "fix")]
    return joined.select(*rest, pick("impact"), pick("fix"))
