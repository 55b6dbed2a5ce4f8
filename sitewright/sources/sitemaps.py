"""Sitemap and robots files, landed as tables, turned into URL rows and per-site facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright import fixed_values as fv
from sitewright.functions import urls as U
from sitewright.functions.ranking import reuse
from sitewright.functions.text import trim_ws

_LOC = r"(?i)<loc>\s*(https?://[^<\s]+)\s*</loc>"


def _files(sitemaps: DataFrame) -> DataFrame:
    """What one sitemap file says; the text itself goes no further."""
    c = F.col
    locs = F.regexp_extract_all("xml", F.lit(_LOC), F.lit(1))
    df = sitemaps.withColumn("_locs", locs)
    plain = F.filter("_locs", lambda u: ~u.endswith(".xml"))
    return df.select(
        "site", "url", "status",
        F.filter("_locs", lambda u: u.rlike(r"(?i)^https?://.+\.xml")).alias("subs"),
        F.when(F.size(plain) > 0, plain).otherwise(c("_locs")).alias("leaves"),
        F.nullif(trim_ws(F.regexp_extract("xml", r"<lastmod>\s*([^<]+)\s*</lastmod>", 1)), F.lit(""))
        .alias("lastmod"),
        (c("status").isin(200, 301, 302)
         & c("xml").rlike("<loc>|<urlset|<sitemapindex")).alias("usable"),
    )


def robots_facts(robots: DataFrame) -> DataFrame:
    """Per site: file found, sitemap declared, disallowed paths, the whole text."""
    c = F.col
    found = F.coalesce((c("status") == 200) & (c("content") != ""), F.lit(False))
    paths = F.filter(
        F.transform(
            F.regexp_extract_all("content", F.lit(r"(?im)^Disallow:[^\S\n\r]*([^\n\r]+)"), F.lit(1)),
            trim_ws),
        lambda p: p != "")
    return robots.select(
        "site", found.alias("robots_found"), c("status").alias("robots_status"),
        F.when(found, c("content")).alias("robots_content"),
        (found & F.coalesce(c("content").rlike(r"(?im)^sitemap:"), F.lit(False)))
        .alias("sitemap_declared"),
        F.when(found, paths).otherwise(F.array().cast("array<string>")).alias("disallowed_paths"),
    )


def sitemap_candidates(sitemaps: DataFrame, robots: DataFrame) -> DataFrame:
    """Files that may be the sitemap of a site: declared ones first, then the usual names."""
    c = F.col
    declared = robots.select("site", F.posexplode(F.regexp_extract_all(
        "content", F.lit(r"(?im)^sitemap:\s*(https?://[^\s]+)"), F.lit(1))).alias("rank", "url"))
    path = U.path(c("url"))
    usual: Column = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(fv.SITEMAP_CANDIDATE_PATHS))):
        usual = F.when(path == name, 1_000_000 + i).otherwise(usual)
    named = sitemaps.filter(U.site(c("url")) == c("site")).select(
        "site", usual.alias("rank"), "url").filter("rank IS NOT NULL")
    return declared.select("site", "rank", "url").unionByName(named).groupBy("site", "url").agg(
        F.min("rank").alias("rank"))


def sitemap_tree(sitemaps: DataFrame, robots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every file that belongs to a candidate, `site, candidate, rank, candidate_status, url, at`, and what files say.

    A candidate's index files are followed to any depth and with all their files.  Each round joins the files that the
    last one found with what they say, and takes on those not seen before under the same candidate, so an index that
    names itself or a file above it ends nothing and repeats nothing.  `at` is the place of a file in the tree, the
    least of several that a round finds.  Each file is read once, whatever the number of rounds.
    """
    c = F.col
    # a file landed for several sites says what the usable one of the first site says
    order = F.struct((~F.coalesce("usable", F.lit(False))).alias("a"), F.col("site").alias("b"), F.hash("subs", "leaves", "lastmod").alias("c"))
    read = reuse(_files(sitemaps), "sitemap_files")
    says = reuse(read.groupBy("url").agg(F.min_by(F.struct("subs", "leaves", "lastmod"), order).alias("says"))
                 .select("url", "says.*"), "sitemap_says")
    key = ["site", "candidate", "url"]
    new = sitemap_candidates(sitemaps, robots).join(
        read.filter("usable").groupBy("site", "url").agg(F.min("status").alias("candidate_status")), ["site", "url"]).select(
        "site", c("url").alias("candidate"), "rank", "candidate_status", "url", F.array().cast("array<int>").alias("at"))
    new = seen = reuse(new, "sitemap_tree")
    while True:
        found = new.join(says.filter(F.size("subs") > 0), "url").select(
            "site", "candidate", "rank", "candidate_status", "at", F.posexplode("subs").alias("i", "sub")).groupBy(
            "site", "candidate", "rank", "candidate_status", c("sub").alias("url")).agg(
            F.min(F.concat("at", F.array("i"))).alias("at"))
        new = reuse(found.join(seen.select(*key), key, "left_anti").join(says.select("url"), "url", "left_semi").select(*seen.columns),
                    "sitemap_tree")
        if new.isEmpty():
            return seen, says
        seen = seen.unionByName(new)


def sitemap_urls(sitemaps: DataFrame, robots: DataFrame) -> DataFrame:
    """URL rows of every candidate: `site, candidate, rank, status, lastmod, url`.

    Files that name other files only lead on to them; the others give their URLs.  The date is the one of the first
    file of the tree that has any.
    """
    c = F.col
    tree, says = sitemap_tree(sitemaps, robots)
    every = tree.join(says, "url").select("site", "candidate", "rank", "candidate_status", "at", "lastmod",
                                          F.when(F.size("subs") > 0, F.array().cast("array<string>")).otherwise(c("leaves")).alias("leaves"))
    dates = every.groupBy("site", "candidate").agg(
        F.min_by("lastmod", F.when(c("lastmod").isNotNull(), c("at"))).alias("lastmod"))
    rows = every.select(
        "site", "candidate", "rank", "candidate_status", F.explode("leaves").alias("url"))
    own = rows.filter(
        (U.site(c("url")) == c("site")) & ~c("url").rlike(fv.SITEMAP_ASSET_PATTERN)).distinct()
    return own.join(dates, ["site", "candidate"])


def site_sitemaps(sitemaps: DataFrame, robots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first candidate of each site that lists URLs: (one row of facts per site, its URLs)."""
    c = F.col
    rows = sitemap_urls(sitemaps, robots)
    counts = rows.groupBy("site", "candidate", "rank", "candidate_status", "lastmod").agg(
        F.count("*").alias("n"))
    best = counts.groupBy("site").agg(F.min_by(
        F.struct("candidate", "candidate_status", "lastmod", "n"),
        F.struct("rank", "candidate")).alias("best"))
    facts = best.select(
        "site", F.lit(True).alias("sitemap_found"), c("best.candidate").alias("sitemap_url"),
        c("best.candidate_status").alias("sitemap_status"), c("best.n").alias("sitemap_url_count"),
        c("best.lastmod").alias("sitemap_lastmod"))
    urls = rows.join(
        best.select("site", c("best.candidate").alias("candidate")), ["site", "candidate"],
        "left_semi").select("site", "url")
    return facts, urls

