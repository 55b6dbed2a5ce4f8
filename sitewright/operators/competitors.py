"""Competing domains: who they are, what they rank for, which keywords are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright import fixed_values as fv
from sitewright.functions.ranking import collect_ranked, top_k
from sitewright.functions.text import compact, keep, let, trim_ws
from sitewright.operators.keywords import competitor_keywords, keyword_gaps


def real_competitors(candidates: DataFrame, *, cap: int | None = None) -> DataFrame:
    """Domains that are no platform, no government site and not the target, ranked; the first `cap`, or all."""
    c = F.col
    kept = candidates.filter(
        (c("domain") != "") & (c("domain") != c("target"))
        & ~c("domain").isin(*fv.GENERIC_PLATFORMS) & ~c("domain").endswith(fv.GOVERNMENT_SUFFIX))
    order = [c("at"), c("domain")]
    if cap is not None:
        return top_k(kept, ["target"], order, cap)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(*order)))


def visibility(shared: Column, missing: Column) -> Column:
    """Share of common keywords in percent."""
    share = F.round(shared / F.greatest(shared + missing, F.lit(1)) * 100)
    return F.least(F.lit(100), share).cast("int")


def competitor_report(candidates: DataFrame, competitor_ranks: DataFrame,
                      own_ranks: DataFrame, *, competitors: int | None = None,
                      keywords_listed: int = 20, gaps_listed: int = 10) -> DataFrame:
    """Competitors of each target with visibility, their keywords and the gaps to them.

    `competitor_ranks` and `own_ranks` are `sources.serp.ranked_keywords` of the competitors and
    of the targets.  All competitors (or the first `competitors`) are compared by all their
    keywords; only the two lists of a row are cut, after counting.
    """
    c = F.col
    comps = real_competitors(candidates, cap=competitors)
    ranks = competitor_ranks.select(
        c("target").alias("domain"), "at", "keyword",
        F.coalesce("position", F.lit(99)).alias("position"), "search_volume")
    pairs = comps.select("target", "domain").join(ranks, "domain")
    known = competitor_keywords(
        pairs.select(c("target").alias("site"), c("domain").alias("competitor"), "at",
                     "keyword", "position", "search_volume"),
        own_ranks.select(c("target").alias("site"), "keyword", "position"))
    counts = known.groupBy("site", "competitor").agg(
        F.count("*").alias("n_keywords"), F.count_if(c("own_position").isNull()).alias("n_gaps"))
    gaps = keyword_gaps(known.drop("at"), cap=gaps_listed)
    row = F.struct("keyword", "position", "search_volume", "own_position")
    top_lists = collect_ranked(
        top_k(known, ["site", "competitor"], [c("at"), c("keyword")], keywords_listed),
        ["site", "competitor"], row, "top_keywords")
    gap_lists = gaps.groupBy("site", "competitor").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"])
        .alias("keyword_gaps"))
    keys = [c("target") == c("site"), c("domain") == c("competitor")]
    n_gaps = F.coalesce("n_gaps", F.lit(0))
    return comps.join(counts, keys, "left").drop("site", "competitor").join(top_lists, keys, "left").drop("site", "competitor").join(
        gap_lists, keys, "left").select(
        "target", "rank", "domain", F.concat(F.lit("https://"), "domain").alias("url"),
        visibility(c("shared_keywords"), c("missing_keywords")).alias("estimated_visibility"),
        "shared_keywords", "missing_keywords",
        F.when(n_gaps > 5, "fill_gaps").otherwise("watch")
        .alias("suggested_action"), F.coalesce("n_keywords", F.lit(0)).alias("n_keywords"), n_gaps.alias("n_gaps"),
        F.coalesce("top_keywords", F.array().cast(
            "array<struct<keyword:string,position:int,search_volume:bigint,own_position:int>>"))
        .alias("top_keywords"),
        F.coalesce("keyword_gaps", F.array().cast("array<string>")).alias("keyword_gaps"))


def keyword_table(keywords: DataFrame, *, cap: int = 25) -> DataFrame:
    """The 25 keywords of a target with the highest volume; an unknown volume counts as zero."""
    c = F.col
    order = [F.coalesce("search_volume", F.lit(0)).desc(), c("keyword")]
    return top_k(keywords, ["target"], order, cap)


def _band(value: Column, high, low, names=("high", "medium", "low")) -> Column:
    return F.when(value >= high, names[0]).when(value >= low, names[1]).when(
        value.isNotNull(), names[2]).otherwise("unknown")


def difficulty_band(v: Column) -> Column:
    return _band(v, 70, 40)


def authority_band(v: Column) -> Column:
    return _band(v, 60, 30)


def visibility_band(v: Column) -> Column:
    return _band(v, 60, 30)


def clarity_band(v: Column) -> Column:
    return _band(v, 70, 40)


def position_band(p: Column) -> Column:
    return (
        F.when(p.isNull(), "unknown").when(p <= 3, "top3").when(p <= 10, "top10")
        .when(p <= 20, "top20").otherwise("beyond")
    )


def markets(languages: Column) -> Column:
    """Markets to query for a site, most important first, from its language tags."""

    def speaks(prefix: str) -> Column:
        spoken = F.exists(languages, lambda tag: tag.startswith(prefix))
        return (spoken | (F.size(languages) == 0)) if prefix == fv.DEFAULT_MARKET_PREFIX else spoken

    def market(place: str, language: str) -> Column:
        return F.struct(F.lit(place).alias("location"), F.lit(language).alias("language"))

    found = compact(*[
        keep(speaks(prefix), market(place, language))
        for _, prefix, place, language in fv.MARKETS])
    default = next(
        F.array(market(place, language)) for _, prefix, place, language in fv.MARKETS
        if prefix == fv.DEFAULT_MARKET_PREFIX)
    return F.when(F.size(found) > 0, found).otherwise(default)


def domains_in_text(text: Column, own_domain: Column, *, cap: int | None = None,
                    snippet_chars: int | None = None) -> Column:
    """Domains named in free text, each with its name and the first line that names it, in order of sight.

    All domains and whole lines, unless a caller asks for fewer or shorter ones.
    """
    shown = (lambda s: s) if snippet_chars is None else (lambda s: F.substring(s, 1, snippet_chars))

    def of_line(line: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(line, F.lit(fv.DOMAIN_PATTERN), F.lit(1)),
            lambda d: F.struct(F.lower(d).alias("domain"), line.alias("line")))

    named = F.flatten(F.transform(F.split(text, "\n"), of_line))
    allowed = F.filter(
        named,
        lambda x: (x["domain"] != own_domain)
        & ~x["domain"].rlike("|".join(fv.GROUNDING_EXCLUDED)))

    def first_only(rows: Column) -> Column:
        """Of the rows sorted by domain and place those that open a domain, by place again."""
        placed = F.array_sort(F.transform(rows, lambda x, i: F.struct(
            x["domain"].alias("domain"), i.alias("at"), x["line"].alias("line"))))
        return let(placed, lambda p: F.array_sort(F.transform(
            F.filter(p, lambda x, i: (i == 0) | (x["domain"] != F.get(p, i - 1)["domain"])),
            lambda x: F.struct(x["at"].alias("at"), x["domain"].alias("domain"), x["line"].alias("line")))))

    first = let(allowed, first_only)
    return F.transform(
        first if cap is None else F.slice(first, 1, cap),
        lambda x: F.struct(
            x["domain"].alias("domain"),
            F.concat(F.upper(F.substring(x["domain"], 1, 1)),
                     F.substring(F.substring_index(x["domain"], ".", 1), 2, 300)).alias("name"),
            shown(trim_ws(x["line"])).alias("snippet")))


def keyword_lines(text: Column, keywords: Column, *, cap: int | None = None) -> Column:
    """For each keyword (or the first `cap`): the first line that mentions it, else the line of its place."""

    def with_lines(lines: Column) -> Column:
        lower = F.transform(lines, F.lower)

        def one(keyword: Column, i: Column, low: Column) -> Column:
            at = F.array_position(F.transform(low, lambda s: F.contains(s, F.lower(keyword))), F.lit(True))
            hit = F.when(at > 0, F.get(lines, at.cast("int") - 1))
            line = F.coalesce(F.nullif(trim_ws(hit), F.lit("")), trim_ws(F.get(lines, i)), F.lit(""))
            return F.struct(keyword.alias("keyword"), line.alias("serp_context"))

        wanted = keywords if cap is None else F.slice(keywords, 1, cap)
        found = let(lower, lambda low: F.transform(wanted, lambda k, i: one(k, i, low)))
        return F.filter(found, lambda x: x["serp_context"] != "")

    return let(F.split(text, "\n"), with_lines)


def merged_sources(*lists: Column, cap: int | None = None) -> Column:
    """Different sources of all lists in order; the first `cap`, or all."""
    every = F.array_distinct(F.concat(*lists))
    return every if cap is None else F.slice(every, 1, cap)
