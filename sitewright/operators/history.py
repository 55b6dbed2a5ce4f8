"""Scan history: a Parquet table of scans, partitioned by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions.text import trim_ws

LISTED = (
    "id", "detected_main_url", "detected_keyword", "detected_article_type", "detected_language",
    "score", "verdict", "final_decision", "created_at",
)
STORED = (
    "id", "raw_input", "detected_main_url", "detected_keyword", "detected_article_type",
    "detected_language", "score", "verdict", "final_decision", "markdown_report", "json_report",
    "rewrite_prompt", "created_at",
)


def scan_rows(scans: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Rows to store: the whole raw input, JSON of score and failures.

    `scans` has the parsed input, `total`, `verdict`, `final_decision`, `failures`, and may have
    the report texts.
    """
    when = F.current_timestamp() if created_at is None else created_at
    extra = {n: F.lit(None).cast("string") for n in ("markdown_report", "rewrite_prompt")
             if n not in scans.columns}
    report = F.to_json(F.struct(
        F.struct("total", "verdict").alias("score"),
        F.col("failures").alias("failureReasons")))
    return scans.withColumns({
        **extra,
        "detected_main_url": F.col("main_url"),
        "score": F.col("total").cast("double"),
        "json_report": report,
        "created_at": when.cast("timestamp_ntz"),
    }).select(*STORED)


#: Scans of one file, for the size of its Bloom filter over ids.
SCANS_OF_A_FILE = 1_000_000


def _writer(rows: DataFrame):
    """A day's files are sorted by id and carry a Bloom filter over it, so a lookup skips most row groups."""
    return rows.sortWithinPartitions("day", "id").write.partitionBy("day").option(
        "parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.expected.ndv#id", str(SCANS_OF_A_FILE))


def append_scans(rows: DataFrame, path: str) -> None:
    _writer(rows.withColumn("day", F.to_date("created_at"))).mode("append").parquet(path)


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def delete_scans(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Rewrites the days that hold the given ids without them, as one write of those days.

    All new files are written aside before the commit puts day after day in its place (dynamic
    partition overwrite); a failure before it changes nothing.  Days that keep no row are removed
    after it, so until then their rows can still be read.  Other days are not touched.
    """
    scans = read_scans(spark, path)
    per_day = scans.join(ids.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left").groupBy("day").agg(
        F.count_if("_gone").alias("gone"), F.count("*").alias("n")).filter("gone > 0").collect()  # one row per day of history
    changed = [r["day"] for r in per_day if r["gone"] < r["n"]]
    if changed:
        kept = scans.filter(F.col("day").isin(changed)).join(ids, "id", "left_anti")
        _writer(kept.repartition("day")).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in per_day:
        if r["gone"] == r["n"]:
            fs.delete(fs_path(f"{path}/day={r['day']}"), True)


def last_days(scans: DataFrame, least: int) -> DataFrame:
    """The scans of the newest days that hold `least` rows together; older days are not read."""
    days = scans.groupBy("day").count().orderBy(F.col("day").desc()).collect()  # one row per day of history
    wanted, n = [], 0
    for r in days:
        if n >= least:
            break
        wanted.append(r["day"])
        n += r["count"]
    return scans.filter(F.col("day").isin(wanted)) if wanted else scans.limit(0)


def recent_scans(scans: DataFrame, *, cap: int = 50) -> DataFrame:
    """The newest 50 scans, newest first; of a stored history only the newest days are read."""
    if "day" in scans.columns:
        scans = last_days(scans, cap)
    return scans.select(*LISTED).orderBy(F.col("created_at").desc(), "id").limit(cap)


def scan_by_id(scans: DataFrame, scan_id: str) -> DataFrame:
    return scans.filter(F.col("id") == scan_id)


def is_blank_input(text: Column) -> Column:
    return F.coalesce(trim_ws(text), F.lit("")) == ""
