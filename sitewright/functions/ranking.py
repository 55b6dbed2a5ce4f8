"""First-k-per-group, and reuse of a result that several operators read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, *, rank: str = "rank",
          salted: bool = True) -> DataFrame:
    """The first `k` rows of every group in a total order, with their rank.

    Spark drops rows beyond `k` before the exchange (a group limit in every map task).  What is
    left of a very large group is still k rows per task, so the salted first step cuts it to
    k rows per salt on many tasks before one task ranks the remainder.
    """
    if salted:
        df = df.withColumn("_salt", F.spark_partition_id() % SALTS)
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_first", F.row_number().over(first)).filter(F.col("_first") <= k)
        df = df.drop("_salt", "_first")
    final = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= k)


def collect_ranked(df: DataFrame, keys: list[str], value: Column, name: str,
                   rank: str = "rank") -> DataFrame:
    """Rows of `top_k` as one array per group, in rank order; at most k values per group."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("at"), value.alias("value"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda x: x["value"]).alias(name))


_OWN_FOLDER: dict[str, str] = {}


def shared_folder(spark) -> str:
    """Folder named by the cluster for intermediate tables, in spark.checkpoint.dir.

    Where it is unset, a local folder serves one machine only; several machines would each write
    to their own disk and lose rows, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN_FOLDER[app]


def shared_path(spark, name: str) -> str:
    """A new path in the shared folder; what is written there is removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    written = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(written)
    return path


def reuse(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back.

    For results read more than once, such as page features: the markup is parsed once, readers get
    column pruning, and a lost executor costs a re-read instead of a re-parse.  The table is
    removed when the session's JVM ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
