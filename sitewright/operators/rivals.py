"""Rivals of every site: the sites whose keywords overlap most, rare keywords counting more than common ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.functions.ranking import reuse, top_k

#: Sites that may use a word for it to be read in each round; the last round reads all. They decide work, not results.
ROUNDS = (16, 256, 4096)
#: Weight of a word that a single site uses; a word of n sites weighs floor(WHOLE / n).
WHOLE = 1_000_000


def weighted_words(words: DataFrame) -> DataFrame:
    """`site, keyword, n_sites, weight` of distinct words, from any table with `site, keyword`."""
    own = words.filter("site IS NOT NULL AND keyword IS NOT NULL").select("site", "keyword").distinct()
    sites = own.groupBy("keyword").agg(F.count("*").alias("n_sites"))
    return own.join(sites, "keyword").select(
        "site", "keyword", "n_sites", F.floor(F.lit(WHOLE) / F.col("n_sites")).alias("weight"))


def _overlaps(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Weight of the common words of every pair of sites that has any."""
    other = theirs.select("keyword", F.col("site").alias("competitor"))
    return mine.join(other, "keyword").filter("site <> competitor").groupBy("site", "competitor").agg(
        F.sum("weight").alias("overlap"))


def site_rivals(words: DataFrame, *, cap: int = 10, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """The `cap` sites of most common weight for each site: `site, rank, competitor, overlap, shared_keywords, missing_keywords`.

    Ties go by name.  Words are read from the rarest: what a site's commoner words weigh together is the most that a
    site not met so far can reach, so when the last place of the list holds more than that, only sites met already are
    completed, by their common words alone.  Sites that rare words don't settle go on to commoner ones, and only they
    do; a word that all sites use pairs sites only where nothing rarer tells them apart.  `missing_keywords` are those
    that the competitor uses and the site does not.
    """
    c = F.col
    table = reuse(weighted_words(words), "site_words")
    shared = table.filter("n_sites > 1")
    open_sites = shared.select("site").distinct()
    done = None
    for most in (*rounds, None):
        near = shared if most is None else shared.filter(c("n_sites") <= most)
        mine = near.join(open_sites, "site", "left_semi")
        partial = reuse(_overlaps(mine, near), "rival_overlaps")
        if most is None:
            exact = partial
        else:
            rest = shared.filter(c("n_sites") > most).join(open_sites, "site", "left_semi")
            left = rest.groupBy("site").agg(F.sum("weight").alias("left"))
            last = top_k(partial, ["site"], [c("overlap").desc(), c("competitor")], cap).groupBy("site").agg(
                F.min("overlap").alias("least"), F.count("*").alias("n"))
            bounds = reuse(open_sites.join(left, "site", "left").join(last, "site", "left").select(
                "site", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("least", F.lit(0)).alias("least"),
                F.coalesce("n", F.lit(0)).alias("n")), "rival_bounds")
            # with no commoner word left the list is whole even if it is short
            settled = bounds.filter((c("left") == 0) | ((c("n") == cap) & (c("least") > c("left"))))
            met = partial.join(settled, "site").filter(c("overlap") + c("left") >= c("least")).select("site", "competitor", "overlap")
            common = met.join(shared.filter(c("n_sites") > most), "site").select("site", "competitor", "keyword", "weight").join(
                shared.filter(c("n_sites") > most).select(c("site").alias("competitor"), "keyword"), ["competitor", "keyword"])
            exact = met.unionByName(common.select("site", "competitor", c("weight").alias("overlap"))).groupBy(
                "site", "competitor").agg(F.sum("overlap").alias("overlap"))
            open_sites = reuse(bounds.join(settled, "site", "left_anti").select("site"), "open_sites")
        first = top_k(exact, ["site"], [c("overlap").desc(), c("competitor")], cap)
        done = first if done is None else done.unionByName(first)
        if most is not None and open_sites.isEmpty():
            break
    pairs = reuse(done.select("site", "rank", "competitor", "overlap"), "site_rivals")
    sizes = table.groupBy(c("site").alias("competitor")).agg(F.count("*").alias("n_words"))
    both = pairs.join(shared, "site").select("site", "competitor", "keyword").join(
        shared.select(c("site").alias("competitor"), "keyword"), ["competitor", "keyword"]).groupBy("site", "competitor").agg(
        F.count("*").alias("shared_keywords"))
    return pairs.join(both, ["site", "competitor"]).join(sizes, "competitor").select(
        "site", "rank", "competitor", "overlap", "shared_keywords", (c("n_words") - c("shared_keywords")).alias("missing_keywords"))
