"""Search-result exports, landed as JSON text, one response per row (`target, response`).

A list may be spread over several responses; their column `offset` says how many items stand before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions.text import trim_ws

_MONTHS = "ARRAY<STRUCT<month INT, year INT, search_volume BIGINT>>"
_INFO = f"STRUCT<search_volume BIGINT, cpc DOUBLE, competition DOUBLE, monthly_searches {_MONTHS}>"
_PROPS = "keyword_properties STRUCT<keyword_difficulty DOUBLE>, search_intent_info STRUCT<main_intent STRING>"
RANKED_RESULT = (
    f"STRUCT<items ARRAY<STRUCT<keyword_data STRUCT<keyword STRING, keyword_info {_INFO}, {_PROPS}>, "
    "ranked_serp_element STRUCT<serp_item STRUCT<rank_absolute INT, rank_group INT, url STRING>>>>>"
)
IDEAS_RESULT = f"STRUCT<items ARRAY<STRUCT<keyword STRING, keyword_info {_INFO}, {_PROPS}>>>"
VOLUME_RESULT = (
    "STRUCT<keyword STRING, search_volume BIGINT, cpc DOUBLE, competition DOUBLE, "
    f"monthly_searches {_MONTHS}>"
)
BACKLINK_RESULT = (
    "STRUCT<backlinks BIGINT, referring_domains BIGINT, broken_backlinks BIGINT, rank BIGINT>"
)
COMPETITOR_RESULT = (
    "STRUCT<items ARRAY<STRUCT<domain STRING, intersections BIGINT, missing_keywords_count BIGINT>>>"
)


CORRUPT = "_corrupt"
LANDED = f"target STRING, api STRING, offset BIGINT, response STRING, {CORRUPT} STRING"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Files of responses, a JSON object with `target, api, offset, response` on each line.

    The schema is fixed, so nothing is inferred.  A line that is no JSON keeps its row, with the line in `_corrupt` and
    nothing else; `file` names the file of a row.
    """
    rows = spark.read.schema(LANDED).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    whole = {n: F.when(F.col(CORRUPT).isNull(), F.col(n)) for n in ("target", "api", "offset", "response")}
    return rows.withColumn("file", F.col("_metadata.file_name")).withColumns(whole)


def _refused(said: Column) -> Column:
    return said.contains("Error") | said.contains("Invalid")


def failed_responses(responses: DataFrame) -> DataFrame:
    """The responses that `results` leaves out, each with a reason and what the service said.

    unreadable: the line or the response is no JSON; no task; refused: by its message; no result.
    """
    c = F.col
    schema = "tasks ARRAY<STRUCT<status_message STRING, result ARRAY<STRING>>>"
    task = F.get(F.from_json("response", schema)["tasks"], F.lit(0))
    said = F.coalesce(c("_task.status_message"), F.lit(""))
    bad = F.try_parse_json("response").isNull()
    if CORRUPT in responses.columns:
        bad = bad | c(CORRUPT).isNotNull()
    reason = (F.when(bad, "unreadable").when(c("_task").isNull(), "no task").when(_refused(said), "refused")
              .when(c("_task.result").isNull(), "no result"))
    kept = [n for n in ("target", "api", "offset", "file") if n in responses.columns]
    return responses.withColumn("_task", task).withColumn("reason", reason).filter("reason IS NOT NULL").select(
        *kept, "reason", c("_task.status_message").alias("message"))


def results(responses: DataFrame, result_type: str) -> DataFrame:
    """Result array of the first task of every response; failed calls give no row."""
    c = F.col
    schema = f"cost DOUBLE, tasks ARRAY<STRUCT<status_message STRING, result ARRAY<{result_type}>>>"
    df = responses.withColumn("_task", F.get(F.from_json("response", schema)["tasks"], F.lit(0)))
    said = F.coalesce(c("_task.status_message"), F.lit(""))
    return df.filter(
        c("_task").isNotNull() & ~_refused(said) & c("_task.result").isNotNull()
    ).select("target", _offset(responses).alias("offset"), c("_task.result").alias("result"))


def _offset(responses: DataFrame) -> Column:
    """Items of a target's list that earlier responses hold; a table without the column has whole lists."""
    return F.coalesce(F.col("offset").cast("int"), F.lit(0)) if "offset" in responses.columns else F.lit(0)


def response_costs(responses: DataFrame) -> DataFrame:
    """What each call cost; needs `scan_id, api, response`."""
    return responses.select("scan_id", "api", F.coalesce(
        F.from_json("response", "cost DOUBLE")["cost"], F.lit(0.0)).alias("cost_usd"))


def _trend(months: Column) -> Column:
    return F.transform(
        F.coalesce(months, F.array().cast(_MONTHS.lower())),
        lambda m: F.struct(m["month"].alias("month"), m["year"].alias("year"),
                           m["search_volume"].alias("volume")))


def _items(df: DataFrame) -> DataFrame:
    first = F.get("result", F.lit(0))["items"]
    return df.select("target", "offset", F.posexplode(first).alias("at", "i")).withColumn(
        "at", F.col("at") + 1 + F.col("offset")).drop("offset")


def rank_priority(position: Column) -> Column:
    return F.when(position <= 3, "High").when(position <= 10, "Medium").otherwise("Low")


def rank_action(position: Column) -> Column:
    return (
        F.when(position.isNull(), "create").when(position <= 3, "protect")
        .when(position <= 10, "improve")
        .when(position <= 20, "refresh")
        .otherwise("support")
    )


def ranked_keywords(responses: DataFrame) -> DataFrame:
    """Keywords a domain ranks for, all of a response, blank ones dropped."""
    c = F.col
    df = _items(results(responses, RANKED_RESULT))
    serp = c("i.ranked_serp_element.serp_item")
    df = df.select(
        "target", "at", F.coalesce(c("i.keyword_data.keyword"), F.lit("")).alias("keyword"),
        serp["rank_absolute"].alias("position"), serp["url"].alias("url"),
        c("i.keyword_data.keyword_info.search_volume").alias("search_volume"),
        c("i.keyword_data.keyword_properties.keyword_difficulty").alias("keyword_difficulty"),
        F.coalesce(c("i.keyword_data.search_intent_info.main_intent"), F.lit("unknown"))
        .alias("intent"))
    return df.filter(trim_ws(c("keyword")) != "").withColumns({
        "priority": rank_priority(c("position")), "suggested_action": rank_action(c("position"))})


def keyword_ideas(responses: DataFrame) -> DataFrame:
    """Related keywords with volume, difficulty, intent and trend, all of a response."""
    c = F.col
    return _items(results(responses, IDEAS_RESULT)).select(
        "target", "at", F.coalesce(c("i.keyword"), F.lit("")).alias("keyword"),
        c("i.keyword_info.search_volume").alias("search_volume"),
        _trend(c("i.keyword_info.monthly_searches")).alias("monthly_trend"),
        c("i.keyword_info.cpc").alias("cpc"), c("i.keyword_info.competition").alias("competition"),
        c("i.keyword_properties.keyword_difficulty").alias("keyword_difficulty"),
        F.coalesce(c("i.search_intent_info.main_intent"), F.lit("unknown")).alias("intent"))


def search_volumes(responses: DataFrame) -> DataFrame:
    """Volumes of the keywords asked for; one call asks for twenty at most."""
    c = F.col
    return results(responses, VOLUME_RESULT).select(
        "target", "offset", F.posexplode("result").alias("at", "i")
    ).select(
        "target", (c("at") + 1 + c("offset")).alias("at"), F.coalesce(c("i.keyword"), F.lit("")).alias("keyword"),
        c("i.search_volume").alias("search_volume"),
        _trend(c("i.monthly_searches")).alias("monthly_trend"), c("i.cpc").alias("cpc"),
        c("i.competition").alias("competition"),
        F.lit(None).cast("double").alias("keyword_difficulty"), F.lit("unknown").alias("intent"))


def backlink_summaries(responses: DataFrame) -> DataFrame:
    c = F.col
    zero = F.lit(0).cast("bigint")
    df = results(responses, BACKLINK_RESULT).withColumn("r", F.get("result", F.lit(0)))
    return df.filter("r IS NOT NULL").select(
        "target", F.coalesce(c("r.backlinks"), zero).alias("total_backlinks"),
        F.coalesce(c("r.referring_domains"), zero).alias("referring_domains"),
        F.coalesce(c("r.broken_backlinks"), zero).alias("lost_backlinks"),
        c("r.rank").alias("domain_rank"))


def competitor_domains(responses: DataFrame) -> DataFrame:
    """Domains that share keywords with the target, in the order of the response."""
    c = F.col
    zero = F.lit(0).cast("bigint")
    return _items(results(responses, COMPETITOR_RESULT)).select(
        "target", "at", c("i.domain").alias("domain"),
        F.coalesce(c("i.intersections"), zero).alias("shared_keywords"),
        F.coalesce(c("i.missing_keywords_count"), zero).alias("missing_keywords"))
