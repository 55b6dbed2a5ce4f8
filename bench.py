"""Times the headline queries at one scale and prints one line of JSON.

Every query runs once to warm up and then three times; the median counts.  Results go to the
`noop` sink, so that every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

RUNS = 3


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sitewright-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sitewright.read.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def headline(spark: SparkSession, sf_dir: str) -> dict:
    from sitewright.operators.article_features import article_features
    from sitewright.operators.inputs import input_markup, parse_inputs
    from sitewright.operators.page_features import page_features
    from sitewright.operators.site import site_facts
    from sitewright.plans import registry
    from sitewright.sources.pages import read_documents, read_pages, read_partitions
    from pyspark.sql import functions as F

    def all_page_features() -> DataFrame:
        return page_features(read_pages(spark, f"{sf_dir}/pages.parquet", read_partitions(spark)))

    def all_article_features() -> DataFrame:
        docs = read_documents(spark, f"{sf_dir}/documents.parquet", read_partitions(spark)).select(
            F.col("doc_id").alias("article_id"), F.col("text").alias("raw_input"))
        return article_features(
            input_markup(parse_inputs(docs)).withColumn("url", F.col("main_url")))

    queries = registry.queries()
    named = (
        "site_scores", "site_issues", "keyword_frequency", "token_cannibalization",
        "url_patterns", "crawl_frontier", "top_pages", "keyword_gaps", "article_scores",
        "article_findings", "competitor_gaps", "article_repeated_phrases", "recent_scans",
    )
    out = {
        "page_features": all_page_features,
        "article_features": all_article_features,
        # from the stored features; the registered queries below read the stored facts
        "site_facts": lambda: site_facts(registry.stored_features_of(spark, sf_dir)),
    }
    for name in named:
        out[name] = lambda q=queries[name]: q(spark, sf_dir)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    seconds = {}
    for name, make in headline(spark, sf_dir).items():
        times = []
        for run in range(RUNS + 1):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            if run:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus,
        "runs": RUNS,
    }))


if __name__ == "__main__":
    main()
