"""Minimum-cost-flow resharding.

Old shards supply their bytes, new shards take up to their capacity, and moving a byte from old shard i to new
shard j has a cost (none where i = j).  The flow of least cost says how many bytes go from where to where; it is a
matter of the shard counts alone and is solved on the driver.  Documents follow it by their place in their old
shard, so that only the files of shards that give or take bytes need to be rewritten.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.common import written

#: An old shard's documents are dealt into so many blocks for each power of two of their size.
BLOCKS = 64


def least_cost_flow(supply: list[int], capacity: list[int], cost: np.ndarray | None = None) -> np.ndarray:
    """Units moved from each old shard to each new one, with the least total cost.

    Successive shortest paths with potentials over source, old shards, new shards and sink.  cost[i, j] is the price
    of a unit; by default 0 where i = j and 1 elsewhere.  The capacities must hold the supply.
    """
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities are smaller than the data")
    cost = (np.arange(n)[:, None] != np.arange(m)[None, :]).astype(float) if cost is None else np.asarray(cost, float)
    flow = np.zeros((n, m), dtype=object)
    left, room = np.array(supply, dtype=object), np.array(capacity, dtype=object)
    price_old, price_new = np.zeros(n), np.zeros(m)
    while left.sum() > 0:
        # shortest distances from the shards that still have bytes; reduced costs are never negative
        far_old = np.where(left > 0, 0.0, np.inf)
        far_new, from_old, from_new = np.full(m, np.inf), np.full(m, -1), np.full(n, -1)
        done_old, done_new = np.zeros(n, bool), np.zeros(m, bool)
        while True:
            a = np.where(done_old, np.inf, far_old)
            b = np.where(done_new, np.inf, far_new)
            i, j = (int(a.argmin()) if n else -1), (int(b.argmin()) if m else -1)
            if a[i] == np.inf and b[j] == np.inf:
                break
            if a[i] <= b[j]:
                done_old[i] = True
                through = far_old[i] + cost[i] + price_old[i] - price_new
                better = through < far_new - 1e-12
                far_new[better], from_old[better] = through[better], i
            else:
                done_new[j] = True
                through = far_new[j] - cost[:, j] + price_new[j] - price_old
                better = (flow[:, j] > 0) & (through < far_old - 1e-12)
                far_old[better], from_new[better] = through[better], j
        ends = np.where(room > 0, far_new + price_new, np.inf)
        j = int(ends.argmin())
        steps, at = [], j
        while True:  # back along the path: old -> new edges carry more, new -> old edges give back
            i = int(from_old[at])
            steps.append((i, at, 1))
            if from_new[i] < 0:
                break
            steps.append((i, int(from_new[i]), -1))
            at = int(from_new[i])
        amount = min([left[i], room[j]] + [flow[x, y] for x, y, sign in steps if sign < 0])
        for x, y, sign in steps:
            flow[x, y] += sign * amount
        left[i] -= amount
        room[j] -= amount
        price_old += np.where(np.isfinite(far_old), far_old, 0)
        price_new += np.where(np.isfinite(far_new), far_new, 0)
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def reshard(sized: DataFrame, shards: int, old: str = "old_shard", size: str = "size",
            capacities: list[int] | None = None, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds shard (int, 0 to shards - 1), slot (long, gapless from 0 in each shard) and moved (boolean).

    sized has an int column `old` (0 or more, not null) and a long column `size` (0 or more, not null); it should be
    narrow, for it is dealt by (old shard, block).  `order` breaks ties and should tell rows apart.  Without
    capacities all shards get the same, so that their bytes differ by about a document.  Rows with the same id are
    placed one by one.  An empty table gives an empty result.
    """
    clash = {"shard", "slot", "moved"} & set(sized.columns)
    sized = sized.drop(*clash)
    names = sized.columns
    level = F.floor(F.log2(F.col(size) + 1)).cast("int")
    rows = written(sized.withColumns({
        "_level": -level, "_block": F.pmod(F.xxhash64(*order), F.lit(BLOCKS)).cast("int")}))
    key = [old, "_level", "_block"]
    blocks = written(rows.groupBy(*key).agg(F.sum(size).alias("_bytes")))
    totals = {r[0]: r[1] for r in blocks.groupBy(old).agg(F.sum("_bytes")).collect()}  # one row per old shard
    n_old = max(totals, default=-1) + 1
    supply = [int(totals.get(i, 0)) for i in range(n_old)]
    flow = least_cost_flow(supply, capacities or equal_capacities(sum(supply), shards))
    cuts = []  # (old, from byte, to byte, new): what stays comes first, at most old + new shards - 1 rows more
    for i in range(n_old):
        at = 0
        for j in sorted(range(shards), key=lambda j: (j != i, j)):
            if flow[i, j]:
                cuts.append([i, at, at + int(flow[i, j]), j])
                at += int(flow[i, j])
        if cuts and cuts[-1][0] == i:
            cuts[-1][2] = 2**62
        else:
            cuts.append([i, 0, 2**62, i % shards])
    spark = sized.sparkSession
    plan = spark.createDataFrame(cuts or [[0, 0, 0, 0]], "_of int, _from long, _to long, shard int")
    bases = blocks.withColumn("_base", F.sum("_bytes").over(
        Window.partitionBy(old).orderBy("_level", "_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_bytes")
    in_block = Window.partitionBy(*key).orderBy(F.col(size).desc(), *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.withColumn("_in_block", F.coalesce(F.sum(size).over(in_block), F.lit(0)))
              .join(bases, key)
              .withColumn("_mid", F.coalesce("_base", F.lit(0)) + F.col("_in_block") + F.expr(f"`{size}` div 2")))
    placed = placed.join(F.broadcast(plan), (F.col(old) == F.col("_of")) & (F.col("_mid") >= F.col("_from")) & (F.col("_mid") < F.col("_to")))
    placed = placed.select(*names, "_level", "_block", "shard")
    cell = [old, "_level", "_block", "shard"]
    placed = written(placed.withColumn("_in_cell", F.row_number().over(Window.partitionBy(*cell).orderBy(F.col(size).desc(), *order)) - 1))
    starts = (placed.groupBy(*cell).count()
              .withColumn("_start", F.coalesce(F.sum("count").over(
                  Window.partitionBy("shard").orderBy(old, "_level", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count"))
    return placed.join(starts, cell).select(
        *names, "shard", (F.col("_start") + F.col("_in_cell")).cast("long").alias("slot"),
        (F.col("shard") != F.col(old)).alias("moved"))


def rewrite(docs: DataFrame, placed: DataFrame, path: str, old: str = "old_shard") -> list[int]:
    """Writes the rows of every shard that gives or takes documents to path/shard=N; returns those shards.

    Shards that nothing moves into or out of are left alone, so their files stay valid.  docs has one row for each row of
    placed and the column `old`; a row finds its place by all columns that the two tables share, nulls included, and rows
    equal in all of these by their number among their like.  Where ids repeat, docs should have the size and the text's
    hash that reshard was given, so that each text gets the place of its size.
    """
    added = {"shard", "slot", "moved"}
    docs = docs.drop(*added)
    shared = [c for c in placed.columns if c in docs.columns and c not in added]
    if old not in shared:
        raise ValueError(f"both tables need the column {old}")
    touched = [r[0] for r in placed.filter("moved").select(F.explode(F.array("shard", old)).alias("s")).distinct().collect()]
    number = F.row_number().over(Window.partitionBy(*shared).orderBy(old))
    # a row that moves makes its old shard touched, so rows that are alike are numbered on both sides or on neither
    rows = docs.filter(F.col(old).isin(touched)).withColumn("_number", number)
    targets = placed.filter(F.col(old).isin(touched)).select(*shared, "shard", "slot").withColumn("_number", number)
    targets = targets.select(F.struct(*shared, "_number").alias("_handle"), "shard", "slot")
    same = [rows[c].eqNullSafe(F.col("_handle")[c]) for c in (*shared, "_number")]
    (rows.join(targets, same).drop("_handle", "_number")
     .repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
    return sorted(touched)


def text_size(text: Column) -> Column:
    """UTF-8 bytes (none for null) plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
