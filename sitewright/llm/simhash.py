"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's bits are cut into segments; the bit counts of the segments are a point of a small integer lattice.
Two fingerprints differ in at least as many bits as their points are apart in Manhattan distance.  Points at most two
apart have a lattice cell within one step of both; so each fingerprint is dealt to its own cell and the cells one step
off, and only fingerprints that share a cell with another one are looked at exactly.  The exact step is of the same
kind on the bits themselves: words at one flipped bit, of which each has at most 65 fingerprints around it, and all
of those differ in at most two bits.  No pairs are made, so groups of near copies cost no more than their members.

For a wider radius the same is done in each of several equal parts: fingerprints that differ in at most 3 * parts - 1
bits differ in at most two bits of some part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.common import skew_safe_left_join, written
from sitewright.llm.components import connected

SHINGLE = 3
SEED = 42
#: Bits of a segment, 2 or 4.  Chance meetings in a cell grow with the square of the fingerprints; with 16 segments of
#: 4 bits about one pair in 10^6 meets, with 32 of 2 bits one in 10^10, for half as many cells again.
SEGMENT_BITS = 2


def simhash(text: str | None, words: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint: a bit is set if it is set in over half the shingles' hashes."""
    own = text.encode().lower().split() if text else []  # bytes: A-Z only; ASCII white space only
    if not own:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False)) if len(own) >= words else [b" ".join(own)]
    h = np.array([digest(s, SEED) for s in shingles], "<u8")
    counts = np.zeros(64, np.int64)
    for part in np.array_split(h, 1 + len(h) // 100_000):  # bounded memory for very long texts
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): one row for each document.  A text without words, or null, has fingerprint zero."""
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([simhash(x.as_py()) for x in batch.column(2)], pa.int64())], names=["doc_id", "text_hash", "fp"])

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    return narrow.mapInArrow(prints, "doc_id long, text_hash long, fp long")


def segment_counts(fp: Column, bits: int = SEGMENT_BITS) -> Column:
    """The bit counts of all segments, each in the place of its segment."""
    every_other, pairs = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    low, high = fp.bitwiseAND(every_other), F.shiftrightunsigned(fp, 1).bitwiseAND(every_other)
    two = F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseXOR(low))  # no sum may pass the sign bit
    return two if bits == 2 else two.bitwiseAND(pairs) + F.shiftrightunsigned(two, 2).bitwiseAND(pairs)


def nearby_cells(point: Column, bits: int = SEGMENT_BITS, places: range = range(64)) -> Column:
    """The lattice cells at most one step from a point, in the segments of these places."""
    steps = []
    for i in places[::bits]:
        value = F.shiftrightunsigned(point, i).bitwiseAND(F.lit((1 << bits) - 1))
        moved = lambda other: point.bitwiseXOR(F.shiftleft(value.bitwiseXOR(other), i))  # noqa: B023, E731
        steps += [F.when(value < bits, moved(value + 1)), F.when(value > 0, moved(value - 1))]
    return F.array_compact(F.array(point, *steps))


def _long(bits: int) -> Column:
    return F.lit(bits - (bits >> 63 << 64))


def near_links(prints: DataFrame, bits: int = SEGMENT_BITS, parts: int = 1) -> DataFrame:
    """(u, v): links that join all fingerprints with two or fewer differing bits in one of so many equal parts.

    They do so directly or by others of them.  prints has the different fingerprints in the long column fp.
    """
    width = 64 // parts
    return reduce(DataFrame.union, [_part_links(prints, bits, range(i, i + width)) for i in range(0, 64, width)]).distinct()


def _part_links(prints: DataFrame, bits: int, places: range) -> DataFrame:
    """near_links by the bits of these places alone."""
    own = F.col("fp") if len(places) == 64 else F.col("fp").bitwiseAND(_long(sum(1 << k for k in places)))
    flips = F.array(own, *[own.bitwiseXOR(_long(1 << k)) for k in places])
    points = prints.select("fp", segment_counts(own, bits).alias("point"))
    cells = points.select("fp", F.explode(nearby_cells(F.col("point"), bits, places)).alias("cell"))
    cell = Window.partitionBy("cell")  # a fingerprint is in a cell once, so no cell holds more than 1 in 33 rows
    met = cells.select("fp", (F.min("fp").over(cell) < F.max("fp").over(cell)).alias("met")).filter("met")
    candidates = written(met.select("fp").distinct())
    words = candidates.select("fp", F.explode(flips).alias("word"))
    return (words.withColumn("least", F.min("fp").over(Window.partitionBy("word")))
            .filter("least < fp").select(F.col("least").alias("u"), F.col("fp").alias("v")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = SEGMENT_BITS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, label): component_id is the smallest id reachable over links of two or fewer bits.

    One row for each row of docs, whatever else it holds; repeated ids and texts are kept.  A component whose ids are
    all null has a null component_id.  label is the component's least fingerprint: unlike component_id it tells apart
    components whose least id is the same.  Copies share a fingerprint and cost one row after the first count.
    """
    prints = written(fingerprints(docs, key, text))
    groups = written(prints.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")))
    labels = connected(near_links(groups.select("fp"), bits))
    named = labels.join(groups, labels.id == groups.fp).groupBy("label").agg(F.count("*").alias("members"), F.min("least").alias("component"))
    inside = skew_safe_left_join(labels, written(named), "label", "members").select("id", "label", "component")
    table = groups.join(inside, groups.fp == inside.id, "left")
    table = written(table.select("fp", "copies", F.coalesce("component", "least").alias("component_id"), F.coalesce("label", "fp").alias("label")))
    return skew_safe_left_join(prints, table, "fp", "copies").select("doc_id", "text_hash", "fp", "component_id", "label")
