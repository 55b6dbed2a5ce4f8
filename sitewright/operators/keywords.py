"""Keywords of sites: tokens, frequency, URL patterns, cannibalisation, gaps to competitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright import fixed_values as fv
from sitewright.functions import urls as U
from sitewright.functions.ranking import collect_ranked, top_k
from sitewright.functions.text import let

_CJK = "[　-鿿가-힯豈-﫿]"
_TOKEN_BREAKS = r"[|–\-:,()\[\]「」【】《》『』、。！？·•\s]+"
_BIGRAM_BREAKS = r"[|–\-:,()\[\]\s]+"
FREQUENCY_CAP = 120


def is_cjk(text: Column) -> Column:
    """More than a fifth of the characters belong to scripts written without spaces."""
    return F.length(F.regexp_replace(text, "[^" + _CJK[1:] + "+", "")) / F.greatest(
        F.length(text), F.lit(1)) > 0.2


def tokens(text: Column) -> Column:
    """Tokens of two characters or more; character 2- and 3-grams for CJK text."""

    def grams(part: Column, n: int) -> Column:
        last = F.length(part) - (n - 1)
        return F.when(
            last >= 1,
            F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(part, i, F.lit(n))),
        ).otherwise(F.array().cast("array<string>"))

    def split(t: Column) -> Column:
        parts = F.filter(F.split(F.lower(t), _TOKEN_BREAKS), lambda w: w != "")
        chars = F.flatten(F.transform(parts, lambda p: F.concat(grams(p, 2), grams(p, 3))))
        return F.when(is_cjk(t), chars).otherwise(F.filter(parts, lambda w: F.length(w) >= 2))

    return let(F.coalesce(text, F.lit("")), split)


def bigrams(text: Column, stop_words=fv.STOP_WORDS) -> Column:
    """Neighbouring pairs of tokens with stop words taken out first; none for CJK text."""
    stops = F.array(*[F.lit(w) for w in stop_words])

    def pairs(ws: Column) -> Column:
        return F.transform(
            F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))),
            lambda w, i: F.concat(w, F.lit(" "), F.get(ws, i + 1)),
        )

    def split(t: Column) -> Column:
        kept = F.filter(
            F.split(F.lower(t), _BIGRAM_BREAKS),
            lambda w: (F.length(w) >= 2) & ~F.array_contains(stops, w))
        return F.when(is_cjk(t), F.array().cast("array<string>")).otherwise(let(kept, pairs))

    return let(F.coalesce(text, F.lit("")), split)


def page_keywords(features: DataFrame, stop_words=fv.STOP_WORDS) -> DataFrame:
    """Distinct keywords of each page: tokens of title, h1, meta and h2s; bigrams of all but meta."""
    c = F.col
    words = F.array_distinct(F.concat(
        tokens(c("title")), tokens(c("h1")), tokens(c("meta_description")),
        F.flatten(F.transform("h2s", tokens))))
    pairs = F.array_distinct(F.concat(
        bigrams(c("title"), stop_words), bigrams(c("h1"), stop_words),
        F.flatten(F.transform("h2s", lambda h: bigrams(h, stop_words)))))
    return features.select(
        "site", "page_id", "page_type", F.explode(F.concat(words, pairs)).alias("keyword"))


def keyword_frequency(features: DataFrame, *, cap: int = FREQUENCY_CAP,
                      stop_words=fv.STOP_WORDS) -> DataFrame:
    """Keywords on two pages of a site or more, most frequent first, the first 120 per site."""
    c = F.col
    counts = page_keywords(features, stop_words).groupBy("site", "keyword").agg(
        F.count("*").alias("n"), F.collect_set("page_type").alias("found_in"))
    stop = ~c("keyword").contains(" ") & c("keyword").isin(*stop_words)
    wanted = counts.filter((c("n") >= 2) & ~stop)
    ranked = top_k(wanted, ["site"], [c("n").desc(), c("keyword")], cap)
    return ranked.select(
        "site", "rank", "keyword", "n", F.sort_array("found_in").alias("found_in"))


def seed_keywords(frequency: DataFrame) -> DataFrame:
    """The ten most frequent keywords of a site, then only those of three characters or more."""
    return frequency.filter((F.col("rank") <= 10) & (F.length("keyword") >= 3)).select(
        "site", "rank", "keyword")


def request_keywords(seeds: DataFrame, *, cap: int = 5) -> DataFrame:
    """Keywords to send with one request: five for keyword ideas, twenty for search volumes."""
    return top_k(seeds.select("site", F.col("rank").alias("seed_rank"), "keyword"), ["site"],
                 [F.col("seed_rank")], cap, salted=False).select("site", "rank", "keyword")


def verified_keywords(frequency: DataFrame) -> DataFrame:
    return frequency.filter(F.col("rank") <= 20).select("site", "rank", "keyword")


def url_patterns(discovered: DataFrame) -> DataFrame:
    """Directory patterns of the URLs of a site, the 20 most frequent, with their first URL."""
    c = F.col
    df = discovered.select("site", "url", U.directory_pattern(U.path(c("url"))).alias("pattern"))
    counts = df.filter("pattern IS NOT NULL").groupBy("site", "pattern").agg(
        F.count("*").alias("n"), F.min("url").alias("example"))
    return top_k(counts, ["site"], [c("n").desc(), c("pattern")], 20).select(
        "site", "rank", "pattern", "n", "example")


def _repeated(occurrences: DataFrame, least: int, groups: int, pages: int) -> DataFrame:
    """Words seen `least` times or more on a site, the `groups` most frequent, with first pages.

    Counting combines on the map side, and each map task keeps no more than `pages` first pages of
    a word; so what meets in one task of a word that all pages use is a few rows for each map task,
    and no occurrence takes part in a join.
    """
    c = F.col
    counts = occurrences.groupBy("site", "keyword", "page_id", "url").agg(
        F.count("*").alias("times")
    ).groupBy("site", "keyword").agg(
        F.sum("times").alias("n_occurrences"), F.count("*").alias("n_pages"))
    top = top_k(counts.filter(c("n_occurrences") >= least), ["site"],
                [c("n_occurrences").desc(), c("keyword")], groups)
    first = collect_ranked(
        top_k(occurrences, ["site", "keyword"], [c("page_id"), c("url")], pages, rank="at"),
        ["site", "keyword"], c("url"), "pages", rank="at")
    return top.join(first, ["site", "keyword"])


def token_cannibalization(features: DataFrame) -> DataFrame:
    """Title tokens of four characters or more that occur three times or more on a site."""
    occurrences = features.select(
        "site", "page_id", "url", F.explode(tokens(F.col("title"))).alias("keyword")
    ).filter(F.length("keyword") >= 4)
    return _repeated(occurrences, 3, 10, 5).select(
        "site", "rank", "keyword", "n_occurrences", "n_pages", "pages")


def title_cannibalization(features: DataFrame) -> DataFrame:
    """Title keywords (letters and digits only) that occur three times or more on a site."""
    occurrences = features.select(
        "site", "page_id", "url", F.explode("title_keywords").alias("keyword"))
    return _repeated(occurrences, 3, 5, 2).select(
        "site", "rank", "keyword", "n_occurrences", "n_pages", "pages")


def own_positions(ranked: DataFrame) -> DataFrame:
    """Position of each own keyword; of several positions the worst one counts."""
    return ranked.filter("position IS NOT NULL").groupBy(
        "site", F.lower("keyword").alias("keyword_key")
    ).agg(F.max("position").alias("own_position"))


def competitor_keywords(competitor_ranks: DataFrame, own: DataFrame) -> DataFrame:
    """Keywords of competitors with our own position, null where we do not rank.

    `competitor_ranks` has `site, competitor, keyword, position, search_volume`, where `site` is
    the audited site; `own` has `site, keyword, position`.
    """
    theirs = competitor_ranks.withColumn("keyword_key", F.lower("keyword"))
    return theirs.join(own_positions(own), ["site", "keyword_key"], "left").drop("keyword_key")


def keyword_gaps(with_own: DataFrame, *, cap: int = 10) -> DataFrame:
    """Keywords a competitor ranks for and we do not, by volume, the first ten per competitor."""
    c = F.col
    gaps = with_own.filter("own_position IS NULL")
    order = [F.coalesce(c("search_volume"), F.lit(0)).desc(), c("keyword")]
    return top_k(gaps, ["site", "competitor"], order, cap).drop("own_position")
