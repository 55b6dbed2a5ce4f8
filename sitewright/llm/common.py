"""What the operators share: written intermediate tables and joins on skewed keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001
#: A written table of narrow rows has one file for so many of them, where their number is known.
PART_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a temporary folder is taken in local mode only (tests); a cluster needs the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_llm_folder", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith(("local[", "local")) or "local-cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext._llm_folder = tempfile.mkdtemp(prefix="spark-")
    return spark.sparkContext._llm_folder


def written(df: DataFrame, at_most: int | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read again; lineage ends here, lost executors don't matter.

    The folder goes when the driver's JVM ends.  at_most: df has narrow rows, and not more than so many; then the files
    grow with the rows instead of with the shuffle partitions.
    """
    spark = df.sparkSession
    df = df if at_most is None else df.coalesce(1 + at_most // PART_ROWS)
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes the folder of a table from `written` that no later step reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def skew_safe_left_join(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows left-joined with table, which has one row per non-null key and in `count` how many rows have that key.

    Keys above HOT_SHARE of all rows are at most 1 / HOT_SHARE; only those are broadcast, and their rows are not
    dealt by key. Both inputs should be written tables: each is read twice or more.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    values = [c for c in table.columns if c != key]
    hot = table.filter(F.col(count) > total * HOT_SHARE)
    packed = lambda df, name: df.select(key, F.struct(*values).alias(name))
    out = rows.join(F.broadcast(packed(hot, "_hot")), key, "left")
    # rows of hot keys need no second lookup: they are spread by a null-safe random-like key of their own
    out = out.withColumn("_cold_key", F.when(F.col("_hot").isNull(), F.struct(F.lit(0).alias("s"), F.col(key).alias("k")))
                         .otherwise(F.struct((F.lit(1) + F.abs(F.hash(*rows.columns)) % 100_000).alias("s"), F.col(key).alias("k"))))
    cold = packed(table.filter(F.col(count) <= total * HOT_SHARE), "_cold").withColumn(
        "_cold_key", F.struct(F.lit(0).alias("s"), F.col(key).alias("k"))).drop(key)
    out = out.join(cold, "_cold_key", "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return out.select(*rows.columns, *[F.col("_found")[c].alias(c) for c in values])


def hex_sha256_of_joined(parts: Column) -> Column:
    return F.sha2(F.concat_ws(",", parts).cast("binary"), 256)
