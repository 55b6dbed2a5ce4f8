"""Page and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_DEFAULTS = (
    ("status", "int", 200),
    ("fetch_ms", "bigint", 0),
    ("final_url", "string", None),
    ("fetch_error", "string", None),
)


def with_page_defaults(df: DataFrame) -> DataFrame:
    """Columns a page table may lack, filled with their defaults: a page without a status is 200.

    Columns that exist are kept as they are, nulls included.
    """
    missing = {
        name: F.lit(default).cast(dtype)
        for name, dtype, default in PAGE_DEFAULTS
        if name not in df.columns
    }
    return df.withColumns(missing).select(
        "page_id", "url", "html", *[n for n, _, _ in PAGE_DEFAULTS]
    )


#: Stored bytes of a part.  A row group is never split, so what one task has to parse must not depend on how files are laid out.
PART_BYTES = 2 << 20


def read_partitions(spark: SparkSession) -> int | None:
    """What a caller asked for in spark.sitewright.read.partitions; unset, the size of the files decides."""
    named = spark.conf.get("spark.sitewright.read.partitions", None)
    return int(named) if named else None


def parts_of(spark: SparkSession, path: str) -> int:
    """How many parts of PART_BYTES the files at a path make."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return -(-sum(fs.getContentSummary(f.getPath()).getLength() for f in fs.globStatus(files)) // PART_BYTES)


def _dealt(df: DataFrame, path: str, key: str, partitions: int | None) -> DataFrame:
    wanted = partitions or parts_of(df.sparkSession, path)
    return df if wanted < 2 else df.repartition(wanted, key)


def read_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """The page table, its rows dealt to `partitions` parts, or to as many as their size asks for."""
    return _dealt(with_page_defaults(spark.read.parquet(path)), path, "page_id", partitions)


def read_documents(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """The document table, its rows dealt to `partitions` parts, or to as many as their size asks for."""
    return _dealt(spark.read.parquet(path), path, "doc_id", partitions)


def documents_as_pages(documents: DataFrame) -> DataFrame:
    """Plain documents in the shape of the article table: text becomes the body of a page."""
    return documents.select(
        F.col("doc_id").alias("article_id"),
        F.lit(None).cast("string").alias("url"),
        F.concat(F.lit("<html><body>"), "text", F.lit("</body></html>")).alias("html"),
    )


def pages_as_articles(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("article_id"), "url", "html")
