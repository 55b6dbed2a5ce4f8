"""Quality checks over answers written by a language model, landed as a table of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sitewright import fixed_values as fv
from sitewright.functions.text import compact, keep, let, trim_ws


def json_block(text: Column) -> Column:
    """The JSON in an answer: of the first code fence, else from the first `{` to the last `}`."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return (
        F.when(text.rlike(r"(?s)```.*?```"), trim_ws(fenced))
        .when(braced != "", braced).otherwise(trim_ws(text))
    )


_LIST = "ARRAY<STRING>"
SITE_ANSWER = ", ".join(
    [f"{n} STRING" for n in fv.ANSWER_REQUIRED_TEXT]
    + [f"{n} {_LIST}" for n in fv.ANSWER_REQUIRED_LISTS]
    + ["expectedResults STRUCT<" + ", ".join(
        f"{p}: {_LIST}" for p in fv.ANSWER_REQUIRED_PERIODS) + ">"]
    + [f"{n} {_LIST}" for n in fv.ANSWER_OPTIONAL_LISTS]
    + ["websiteInsightSummary STRING", "salesInsight STRING"]
)
ARTICLE_ANSWER = (
    "oneSentenceTruth STRING, topProblems ARRAY<STRING>, topFixes ARRAY<STRING>, "
    "rewriteBrief STRING, titleOptions ARRAY<STRING>, metaOptions ARRAY<STRING>, "
    "h2Suggestions ARRAY<STRING>, faqSuggestions ARRAY<STRUCT<q: STRING, a: STRING>>, "
    "aiInsight STRING"
)


def parsed_answers(answers: DataFrame, schema: str, *, column: str = "text") -> DataFrame:
    """Adds `answer`, the typed JSON of the text, and `is_parsed`; a bad text is a row, no failure."""
    df = answers.drop("is_parsed", "answer").withColumn("_json", json_block(F.col(column)))
    ok = F.try_parse_json("_json").isNotNull() & F.col("_json").startswith("{")
    # a row generated from one struct: what reads the answer later does not parse it again
    parsed = F.struct(F.coalesce(ok, F.lit(False)).alias("is_parsed"), F.when(ok, F.from_json("_json", schema)).alias("answer"))
    return df.select("*", F.inline(F.array(parsed))).drop("_json")


def missing_fields(answer: Column) -> Column:
    """Required fields of a site answer that are absent, blank or empty."""

    def blank(c: Column) -> Column:
        return F.coalesce(trim_ws(c), F.lit("")) == ""

    def empty(c: Column) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) <= 0

    return compact(
        *[keep(blank(answer[n]), n) for n in fv.ANSWER_REQUIRED_TEXT],
        *[keep(empty(answer[n]), n) for n in fv.ANSWER_REQUIRED_LISTS],
        *[keep(empty(answer["expectedResults"][p]), f"expectedResults.{p}")
          for p in fv.ANSWER_REQUIRED_PERIODS],
    )


def checked_site_answers(answers: DataFrame) -> DataFrame:
    """Adds the missing fields of each answer, and whether it is accepted."""
    df = parsed_answers(answers, SITE_ANSWER)
    df = df.withColumn("missing", F.when(F.col("is_parsed"), missing_fields(F.col("answer"))))
    return df.withColumn(
        "is_accepted", F.col("is_parsed") & (F.coalesce(F.size("missing"), F.lit(1)) == 0))


def _rejection(df: DataFrame) -> Column:
    """Why a checked answer is not accepted; null for one that is."""
    broken = F.when(F.coalesce(F.col("_text"), F.lit("")).contains("{"), "broken_json").otherwise("no_json")
    return F.when(~F.col("is_parsed"), broken).when(~F.col("is_accepted"), "missing_fields")


def rejected_site_answers(answers: DataFrame, *, column: str = "text") -> DataFrame:
    """The answers that are not accepted, with a reason and the missing fields; no text fails a job."""
    df = checked_site_answers(answers.withColumn("_text", F.col(column)))
    return df.withColumn("reason", _rejection(df)).filter("reason IS NOT NULL").drop("_text", "answer")


def counted_site_answers(answers: DataFrame, *, column: str = "text") -> tuple[DataFrame, Observation]:
    """`checked_site_answers` with counts by reason, taken in the pass that parses; read them after an action."""
    counts = Observation()
    df = checked_site_answers(answers.withColumn("_text", F.col(column)))
    reason = _rejection(df)
    return df.observe(counts, F.count(F.lit(1)).alias("answers"), F.count_if("is_accepted").alias("accepted"), *[
        F.count_if(reason == r).alias(r) for r in ("no_json", "broken_json", "missing_fields")]).drop("_text"), counts


def with_empty_lists(answer: Column) -> Column:
    """The answer with empty lists and texts where optional fields are absent."""
    none = F.array().cast("array<string>")
    out = answer
    for n in fv.ANSWER_OPTIONAL_LISTS:
        out = out.withField(n, F.coalesce(answer[n], none))
    for n in ("websiteInsightSummary", "salesInsight"):
        out = out.withField(n, F.coalesce(answer[n], F.lit("")))
    return F.when(answer.isNotNull(), out)


def brief_lines(brief: Column) -> Column:
    """A brief given as text or as a JSON list: its trimmed, non-empty lines."""

    def lines(b: Column) -> Column:
        as_list = F.from_json(b, "array<string>")
        split = F.filter(F.transform(F.split(b, "\n"), trim_ws), lambda s: s != "")
        return F.when(b.startswith("["), as_list).otherwise(split)

    return let(brief, lines)


def brief_text(lines: Column) -> Column:
    bullet = F.transform(lines, lambda s: F.concat(
        F.lit("• "), F.regexp_replace(s, r"^[•\-]\s*", "")))
    return F.array_join(bullet, "\n")


def checked_article_answers(answers: DataFrame) -> DataFrame:
    """Adds the list fields that break their size bounds, and whether the answer is accepted."""
    c = F.col
    df = parsed_answers(answers, ARTICLE_ANSWER).withColumn(
        "brief", brief_lines(c("answer.rewriteBrief")))

    def size(n: str) -> Column:
        return F.coalesce(F.size("brief" if n == "rewriteBrief" else f"answer.{n}"), F.lit(-1))

    bad = compact(
        keep(c("answer.oneSentenceTruth").isNull(), "oneSentenceTruth"),
        *[keep(~size(n).between(least, most), n) for n, least, most in fv.ARTICLE_ANSWER_BOUNDS])
    df = df.withColumn("out_of_bounds", F.when(c("is_parsed"), bad))
    return df.withColumn(
        "is_accepted", c("is_parsed") & (F.coalesce(F.size("out_of_bounds"), F.lit(1)) == 0))


def error_class(message: Column) -> Column:
    def classify(low: Column) -> Column:
        out = None
        for name, parts in fv.ERROR_CLASSES:
            hit = F.lit(False)
            for p in parts:
                hit = hit | F.contains(low, F.lit(p))
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise("other")

    return let(F.lower(message), classify)


def is_retryable(message: Column) -> Column:
    def any_word(low: Column) -> Column:
        hit = F.lit(False)
        for word in fv.RETRYABLE_ERROR_WORDS:
            hit = hit | F.contains(low, F.lit(word))
        return hit

    return let(F.lower(message), any_word)


MERGED_FIELDS = (
    ("one_sentence_truth", "oneSentenceTruth"), ("top_problems", "topProblems"),
    ("top_fixes", "topFixes"), ("rewrite_brief", None), ("title_options", "titleOptions"),
    ("meta_options", "metaOptions"), ("h2_suggestions", "h2Suggestions"),
    ("faq_suggestions", "faqSuggestions"),
)


def merged_scans(findings: DataFrame, answers: DataFrame) -> DataFrame:
    """Rule values per scan, replaced field by field by those of an accepted answer.

    `findings` has `scan_id` and any of the merged fields; `answers` is
    `checked_article_answers` of a table with `scan_id`.
    """
    c = F.col
    good = answers.filter("is_accepted").select(
        "scan_id", c("answer").alias("_answer"), brief_text(c("brief")).alias("_brief"))
    df = findings.join(good, "scan_id", "left")
    for name, field in MERGED_FIELDS:
        if name in findings.columns:
            value = c("_brief") if field is None else c("_answer")[field]
            df = df.withColumn(name, F.coalesce(value, c(name)))
    return df.withColumn("is_ai_enhanced", c("_answer").isNotNull()).drop("_answer", "_brief")
