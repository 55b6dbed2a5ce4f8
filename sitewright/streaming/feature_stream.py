"""Feature tables kept up to date from arriving pages.

The feature operators are stateless projections, so they run unchanged on a stream; nothing here
keeps state or needs a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sitewright.operators.page_features import page_features
from sitewright.sources.pages import with_page_defaults

PAGE_SCHEMA = (
    "page_id BIGINT, url STRING, html STRING, status INT, fetch_ms BIGINT, final_url STRING, "
    "fetch_error STRING"
)


def page_stream(spark: SparkSession, path: str, schema: str = PAGE_SCHEMA) -> DataFrame:
    """New page files of a folder as a stream."""
    return with_page_defaults(spark.readStream.schema(schema).parquet(path))


def write_feature_stream(pages: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends the features of arriving pages to a Parquet table, all available files at once."""
    return (
        page_features(pages, **options).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    )
