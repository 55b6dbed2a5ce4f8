"""The audit of all sites of a page table, as one job per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.functions.ranking import reuse
from sitewright.operators import issues as I
from sitewright.operators import keywords as K
from sitewright.operators import page_ranking as R
from sitewright.operators import site as S
from sitewright.operators.page_features import page_features
from sitewright.sources.sitemaps import robots_facts, site_sitemaps


def site_audit(pages: DataFrame, *, sitemaps: DataFrame | None = None,
               robots: DataFrame | None = None, strict: bool = False) -> dict[str, DataFrame]:
    """All tables of an audit, by name.

    The markup is parsed once into a stored feature table; everything else reads that table, and
    the markup itself never goes through a shuffle.
    """
    features = reuse(page_features(pages, strict=strict), "page_features")
    if sitemaps is not None and robots is None:  # no site has a robots file
        robots = sitemaps.sparkSession.createDataFrame([], "site string, status int, content string")
    facts_of_robots = None if robots is None else robots_facts(robots)
    facts_of_sitemaps = urls = None
    if sitemaps is not None:
        facts_of_sitemaps, urls = site_sitemaps(sitemaps, robots)
    facts = reuse(
        S.site_facts(features, sitemaps=facts_of_sitemaps, robots=facts_of_robots,
                     sitemap_urls=urls), "site_facts")
    discovered = S.discovered_urls(features, urls)
    ok = S.ok_pages(features)
    frequency = K.keyword_frequency(ok)
    issues = I.site_issues(facts, features, strict=strict)
    strengths = S.site_strengths(facts, strict=strict)
    sitemap = S.recommended_sitemap(features, urls, strict=strict)
    return {
        "page_features": features,
        "site_facts": facts,
        "site_summary": S.site_summary(facts),
        "site_scores": S.site_scores(facts),
        "site_issues": issues,
        "issue_counts": I.issue_counts(issues, strengths),
        "site_strengths": strengths,
        "content_audit": S.content_audit(facts, features),
        "schema_coverage": S.schema_coverage(facts),
        "page_type_counts": S.page_type_counts(features, strict=strict),
        "recommended_sitemap": sitemap,
        "sitemap_report_groups": S.sitemap_report_groups(sitemap),
        "discovered_urls": discovered,
        "crawl_frontier": R.crawl_frontier(S.crawl_queue(features, urls)),
        "keyword_frequency": frequency,
        "seed_keywords": K.seed_keywords(frequency),
        "url_patterns": K.url_patterns(discovered),
        "token_cannibalization": K.token_cannibalization(ok),
        "top_pages": R.top_pages(features),
        "context_pages": R.context_pages(features),
        "verified_urls": R.verified_urls(features),
        "page_title_lines": R.page_title_lines(features),
    }


def audit_overview(pages: DataFrame) -> DataFrame:
    """Scores of every site beside its fired issues, one row per issue."""
    features = reuse(page_features(pages), "page_features")
    facts = reuse(S.site_facts(features), "site_facts")
    scores = S.site_scores(facts)
    issues = I.site_issues(facts, features, with_examples=False)
    return scores.join(
        issues.select("site", "issue_id", "priority", "category", "affected_count"), "site", "left"
    ).withColumn("grade", S.score_grade(F.col("overall")))
