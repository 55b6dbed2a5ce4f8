"""Costs of scans, and how often a brand shows up in answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright import fixed_values as fv


def api_costs(calls: DataFrame) -> DataFrame:
    """Cost per scan and API; `calls` has `scan_id, api, cost_usd`."""
    return calls.groupBy("scan_id", "api").agg(
        F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("n_calls"))


def model_costs(usage: DataFrame, prices=fv.MODEL_PRICES) -> DataFrame:
    """Cost of model use; `usage` has `scan_id, model, input_tokens, output_tokens, prompt_chars`.

    A call without token counts is estimated from its prompt; an unknown model has the price of
    the most expensive one.  The price list is a handful of literal rows in the plan.
    """
    c = F.col
    known = (F.coalesce("input_tokens", F.lit(0)) != 0) | (
        F.coalesce("output_tokens", F.lit(0)) != 0)
    default = next(p for p in prices if p[0] == fv.DEFAULT_PRICE_MODEL)

    def price(i: int):
        out = F.lit(default[i])
        for row in prices:
            out = F.when(c("model") == row[0], row[i]).otherwise(out)
        return out

    tokens_in = F.when(known, F.coalesce("input_tokens", F.lit(0))).otherwise(
        F.round(c("prompt_chars") / fv.CHARS_PER_TOKEN))
    tokens_out = F.when(known, F.coalesce("output_tokens", F.lit(0))).otherwise(
        fv.ESTIMATED_OUTPUT_TOKENS)
    df = usage.select(
        "scan_id", "model", tokens_in.cast("bigint").alias("input_tokens"),
        tokens_out.cast("bigint").alias("output_tokens"), (~known).alias("is_estimated"))
    return df.withColumn(
        "cost_usd",
        c("input_tokens") / 1e6 * price(1) + c("output_tokens") / 1e6 * price(2))


def scan_costs(model_use: DataFrame, calls: DataFrame) -> DataFrame:
    """Total per scan in USD and THB; a scan may lack either part."""
    c = F.col
    model = model_use.groupBy("scan_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("model_cost_usd"))
    api = calls.groupBy("scan_id").agg(F.sum("cost_usd").alias("api_cost_usd"))
    df = model.join(api, "scan_id", "full").fillna(
        0, ["input_tokens", "output_tokens", "model_cost_usd", "api_cost_usd"])
    df = df.withColumn("total_cost_usd", c("model_cost_usd") + c("api_cost_usd"))
    return df.withColumn("total_cost_thb", c("total_cost_usd") * fv.THB_PER_USD)


def answer_visibility(probes: DataFrame) -> DataFrame:
    """Per site: how often the brand appears in answers; `probes` has one row per prompt."""
    c = F.col
    df = probes.groupBy("site").agg(
        F.count("*").alias("n"), F.count_if("brand_appears").alias("brand"),
        F.count_if(c("citation_gap") == "High").alias("citation_source_gaps"))
    share = c("brand") / c("n")
    return df.select(
        "site",
        F.when(share < 0.3, "Low").when(share < 0.6, "Medium").otherwise("High")
        .alias("brand_mention_status"),
        F.lit("Medium").alias("competitor_mentions"), "citation_source_gaps",
        (c("n") - c("brand")).alias("prompt_opportunities"),
        F.round(c("n") * 0.75).cast("bigint").alias("faq_opportunities"),
        F.least(F.lit(100), 40 + c("brand") * 8).alias("entity_clarity_score"))
