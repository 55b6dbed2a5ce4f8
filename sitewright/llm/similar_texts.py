"""Near-duplicates by the Jaccard similarity of word shingles, exact: no pair above the bound is missed or guessed.

First the lattice of `simhash` links texts whose fingerprints differ in few bits, and an exact check of the sets follows.
Texts as similar as 0.8 have fingerprints about ten bits apart, more than lattice cells can tell from chance, so the
pairs that the lattice leaves are found by their shingles:
each text's shingle hashes are put in one order that all texts share, the very common ones last.  Of two
texts that are similar enough, the first part of each (a fifth, for 0.8) has a shingle in common, at places and
sizes that leave room for the overlap.  Of these pairs, parity bits of the sets rule out most that are too far apart: a
bit tells whether an even or odd number of a set's hashes fall on it, so no two sets differ in more bits than in
members.  What is left is compared by whole sets.  Each text of a shingle meets one other first, then of any two groups
still apart the pair whose bits are most alike; only texts that these comparisons have not joined yet are then paired,
so groups of near copies stay cheap.  From turn to turn only groups are joined, and links inside a group are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.common import skew_safe_left_join, written
from sitewright.llm.components import connected
from sitewright.llm.simhash import near_links, simhash

SEED = 42
#: One text of so many is looked at for common shingles, which are put last; this changes work, not results.
SAMPLE, COMMON, MOST_COMMON = 4, 3, 200_000
#: Turns that compare few pairs, in proportion to the texts or to the groups still apart, before all others are compared.
STARS = 3
#: Parts and segments of the fingerprints: those five or fewer bits apart are linked, and farther ones that agree in a half.
PARTS, PART_SEGMENT_BITS = 2, 4
#: Longs of parity bits of a set.
LONGS = 8
PARITY = [f"p{i}" for i in range(LONGS)]


def sequence_hash(text: str | None) -> int:
    """The signed 64-bit hash of a text's words; A-Z count as small letters."""
    digest = xxhash.xxh64_intdigest(b" ".join(text.encode().lower().split()) if text else b"", SEED)
    return digest - (digest >> 63 << 64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different hashes of a text's shingles, ascending; a shorter text is one shingle, one without words has none."""
    own = text.encode().lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    n = min(words, len(own))
    shingles = map(b" ".join, zip(*(own[i:len(own) - n + 1 + i] for i in range(n)), strict=True))
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), np.uint64).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * (100 + percent) >= percent * (len(a) + len(b))


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """LONGS longs; sets differ in at least as many members as in bits."""
    odd = np.bincount(hashes.view(np.uint64) % np.uint64(64 * LONGS), minlength=64 * LONGS).astype(np.uint8) & 1
    return np.packbits(odd).view(">i8").astype(np.int64)


def _apart() -> Column:
    """The number of differing parity bits of a pair, p and p_o."""
    return sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}_o"))) for p in PARITY[1:]), F.bit_count(F.col(PARITY[0]).bitwiseXOR(F.col(f"{PARITY[0]}_o"))))


def _near(percent: int) -> Column:
    """The parity bits of a pair leave it possible that the sets of n and n_o members are similar."""
    return _apart() * (100 + percent) <= (F.col("n") + F.col("n_o")) * (100 - percent)


def _common_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """Hashes of shingles that are common in a sample, ascending by number of texts."""
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x.as_py(), words))], names=["h"])

    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct()
    found = (sample.mapInArrow(shingles, "h long").groupBy("h").count().filter(F.col("count") >= COMMON)
             .orderBy(F.desc("count"), "h").limit(MOST_COMMON).select("h").toArrow())
    return found.column("h").to_numpy()[::-1].copy()


def _shared(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(h, seq, n, pos): the first shingles of each different text, of those that two texts or more have there."""
    common = _common_shingles(texts, words)
    by_hash = np.argsort(common)
    ascending = common[by_hash]

    def first_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for x in batch.column(0):
                text = x.as_py()
                seq = sequence_hash(text)
                if seq in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(seq)
                h = shingle_set(text, words)
                rank = np.zeros(len(h), np.int64)
                if len(ascending):
                    at = np.minimum(np.searchsorted(ascending, h), len(ascending) - 1)
                    rank = np.where(ascending[at] == h, by_hash[at] + 1, 0)
                n = len(h)
                first = h[np.lexsort((h, rank))][:n + (percent * -n // 100) + 1 if n else 0]
                size = len(first)
                yield pa.RecordBatch.from_arrays([
                    pa.array(first), pa.array(np.full(size, seq)), pa.array(np.full(size, n, np.int32)), pa.array(np.arange(size, dtype=np.int32))],
                    names=["h", "seq", "n", "pos"])

    rows = texts.mapInArrow(first_part, "h long, seq long, n int, pos int").repartition("h").groupBy("h", "seq").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    of = Window.partitionBy("h")
    return written(rows.withColumn("_met", F.min("seq").over(of) < F.max("seq").over(of)).filter("_met").drop("_met"))


def _wanted(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(seq, text, n, parity bits): one text for each of the word sequences in wanted, and of its set size and bits."""
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sequence_hash(x.as_py()) for x in batch.column(0)], pa.int64()), batch.column(0)], names=["seq", "text"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), words) for x in batch.column(1)]
            bits = np.array([parity_bits(s) for s in sets], np.int64).reshape(-1, LONGS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(s) for s in sets], pa.int32()), *[pa.array(bits[:, i]) for i in range(LONGS)]],
                                             names=["seq", "text", "n", *PARITY])

    one = texts.mapInArrow(named, "seq long, text string").join(wanted, "seq", "left_semi").groupBy("seq").agg(F.min("text").alias("text"))
    return written(one.mapInArrow(measured, "seq long, text string, n int, " + ", ".join(f"{p} long" for p in PARITY)))


def _similar_pairs(pairs: DataFrame, chosen: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs (u, v, label_u, label_v), the labels of those whose whole texts are similar, as (u, v).

    Texts are sent, for they pack better than hashes, where bits don't decide.
    """
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None  # pairs of one u mostly follow each other
        for batch in batches:
            kept = []
            for u, a, b in zip(*(batch.column(c) for c in ("u", "a", "b")), strict=True):
                if u.as_py() != at:
                    at, own = u.as_py(), shingle_set(a.as_py(), words)
                kept.append(similar(own, shingle_set(b.as_py(), words), percent))
            yield batch.select(["label_u", "label_v"]).filter(pa.array(kept, pa.bool_()))

    bits_u = chosen.select(F.col("seq").alias("u"), *[F.col(x).alias(f"{x}_o") for x in ("n", *PARITY)])
    pairs = pairs.join(chosen.select(F.col("seq").alias("v"), "n", *PARITY), "v").join(bits_u, "u").filter(_near(percent)).select("u", "v", "label_u", "label_v")
    of_u, of_v = chosen.select(F.col("seq").alias("u"), F.col("text").alias("a")), chosen.select(F.col("seq").alias("v"), F.col("text").alias("b"))
    return pairs.join(of_v, "v").join(of_u, "u").select("u", "v", "label_u", "label_v", "a", "b").mapInArrow(exact, "u long, v long")


def _joined(labels: DataFrame, joins: DataFrame) -> DataFrame:
    """labels (id, label) with the labels that joins (id, label) puts together; an id without a label so far is its own."""
    every = labels.union(joins.select("id", F.col("id").alias("label"))).distinct()
    to = joins.select(F.col("id").alias("label"), F.col("label").alias("least"))
    return written(every.join(to, "label", "left").select("id", F.coalesce("least", "label").alias("label")), labels.count() + joins.count())


def fingerprint_pairs(texts: DataFrame, words: int) -> DataFrame:
    """(u, v): pairs of different texts, by the hashes of their words, whose fingerprints are equal or linked by the lattice."""
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            found = {}
            for x in batch.column(0):
                text = x.as_py()
                seq = sequence_hash(text)
                if seq not in seen and seq not in found:
                    found[seq] = simhash(text, words)
            if len(seen) < 1_000_000:
                seen.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["seq", "fp"])

    rows = written(texts.mapInArrow(prints, "seq long, fp long").distinct())
    first = written(rows.groupBy("fp").agg(F.min("seq").alias("first")))
    same = rows.join(first, "fp").filter("first < seq").select(F.col("first").alias("u"), F.col("seq").alias("v"))
    of = lambda end: first.select(F.col("fp").alias(end), F.col("first").alias(f"of_{end}"))
    near = near_links(first.select("fp"), PART_SEGMENT_BITS, PARTS).join(of("u"), "u").join(of("v"), "v")
    return same.union(near.select(F.least("of_u", "of_v"), F.greatest("of_u", "of_v")))


def similar_links(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, label) of every different text that another is similar to, over chains of similar pairs.

    texts has the column text.  id is the hash of the text's words, label the least id of the component.
    """
    pairs = fingerprint_pairs(texts, words)
    shared = _shared(texts, words, percent)
    chosen = _wanted(texts, shared.select("seq").distinct(), words)
    # room for the overlap: at the first common shingle of a similar pair, it and what follows hold the whole overlap
    room = F.expr(f"least(n - pos, n_o - pos_o) * {100 + percent} >= {percent} * (n + n_o) AND n * 100 >= {percent} * n_o AND n_o * 100 >= {percent} * n")
    of = Window.partitionBy("h")
    pairs = pairs.select("u", "v", F.col("u").alias("label_u"), F.col("v").alias("label_v"))
    labels = connected(_similar_pairs(pairs, chosen, words, percent))  # a text that shares no first shingle is similar to none
    for turn in range(STARS + 1):
        open_rows = shared.join(labels.withColumnRenamed("id", "seq"), "seq", "left").withColumn("label", F.coalesce("label", "seq"))
        open_rows = open_rows.withColumn("_open", F.min("label").over(of) < F.max("label").over(of)).filter("_open").drop("_open")
        if turn < STARS - 1:
            # a text with few rare shingles before the common one is likely in the middle of its group
            order = F.col("pos") if turn == 0 else F.xxhash64("h", "seq")
            star = F.min(F.struct(order.alias("o"), "seq", "n", "pos", "label")).over(of)
            pairs = open_rows.withColumn("_s", star).select(
                "*", *[F.col("_s")[c].alias(f"{c}_o") for c in ("seq", "n", "pos", "label")])
        else:
            open_rows = written(open_rows.join(chosen.select("seq", *PARITY), "seq"))
            other = open_rows.select("h", *[F.col(c).alias(f"{c}_o") for c in ("seq", "n", "pos", "label", *PARITY)])
            pairs = open_rows.join(other, "h").filter("seq_o < seq").filter(_near(percent))
        pairs = pairs.filter("label <> label_o").filter(room)
        if turn == STARS - 1:  # of two groups the pair that looks most alike; what it joins needs no other pairs
            alike = F.struct((_apart() / (F.col("n") + F.col("n_o"))).alias("apart"), "seq", "seq_o")
            pairs = pairs.groupBy("label", "label_o").agg(F.min(alike).alias("_s")).select("label", "label_o", "_s.seq", "_s.seq_o")
        pairs = pairs.select(
            F.col("seq_o").alias("u"), F.col("seq").alias("v"), F.col("label_o").alias("label_u"), F.col("label").alias("label_v")).distinct()
        labels = _joined(labels, connected(_similar_pairs(pairs, chosen, words, percent)))
    return labels


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, label): rows whose texts are joined by chains of similar pairs have one label.

    Two texts are similar when their sets of shingles of so many words have a Jaccard similarity of percent / 100 or
    more; texts of the same words always are.  One row for each row of docs; ids may be null or repeated.
    """
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([sequence_hash(x.as_py()) for x in batch.column(2)], pa.int64())], names=["doc_id", "text_hash", "seq"])

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    rows = written(narrow.mapInArrow(named, "doc_id long, text_hash long, seq long"))
    groups = rows.groupBy("seq").agg(F.count("*").alias("copies"))
    labels = similar_links(docs.select(F.col(text).alias("text")), words, percent)
    table = written(groups.join(labels, groups.seq == labels.id, "left").select("seq", "copies", F.coalesce("label", "seq").alias("label")))
    return skew_safe_left_join(rows, table, "seq", "copies").select("doc_id", "text_hash", "label")
