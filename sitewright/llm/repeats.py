"""Word windows that stand in more than one document: what the sparse-suffix and the automaton operator share.

Every window of n words has an anchor, the k-gram in it with the least hash (a minimiser): equal windows have equal
anchors at equal places.  Three reads of the documents narrow the work down, each with a bit set of bounded size made
from the counts of the one before:

1. anchors that stand in two documents or more;
2. windows around such anchors that stand in two documents or more;
3. runs of such windows with one anchor become segments, which are dealt by their anchor's hash.

A bit set may let too much through, never too little; the operators then compare the words themselves.  Each task
keeps the equal segments of its block of documents once, with the least and greatest id, so that a passage in
thousands of documents, or thousands of copies of a document, meet as one segment for each block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.bpe import _ragged, pack_numbers, pack_words, unpack_numbers, unpack_words
from sitewright.llm.common import drop_written, written

#: Documents are worked on in blocks of about so many characters.
BLOCK_CHARS = 3_000_000
#: Bit sets have 16 bits for each member, and this many at most (32 MB).
MOST_BITS = 1 << 28
#: Bits of a part of a bit set that a task sends.
PART = 1 << 16
#: Shards of a bucket; each is solved on its own, so many that most hold the segments of one anchor.
SHARDS = 1 << 20
HIGHEST = 2**63 - 1
_M = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_M, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows(NamedTuple):
    """All windows of some texts: words, words of each text, and for each window its text, start, anchor and hashes."""

    words: list[list[bytes]]
    first: np.ndarray
    text: np.ndarray
    start: np.ndarray
    anchor: np.ndarray
    anchor_hash: np.ndarray
    hash: np.ndarray


def windows_of(texts: list[str], n: int, k: int) -> Windows:
    words = [t.encode().split() for t in texts]  # bytes: ASCII white space only
    sizes = np.array([len(x) for x in words], np.int64)
    first, total = np.cumsum(sizes) - sizes, int(sizes.sum())
    text = np.repeat(np.arange(len(texts)), np.maximum(sizes - n + 1, 0))
    start = _ragged(first, np.maximum(sizes - n + 1, 0))
    if not len(start):
        empty = np.zeros(0, np.uint64)
        return Windows(words, first, text, start, start, empty, empty)
    h = mix(np.fromiter((zlib.crc32(w) for x in words for w in x), np.uint64, total) + np.uint64(1))
    powers = lambda base: np.concatenate([[np.uint64(1)], np.cumprod(np.full(total, base, np.uint64))])
    up, down = powers(_M), powers(_INVERSE)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[:-1])])
    grams = mix((sums[k:] - sums[:-k]) * down[:len(sums) - k])
    anchor = _leftmost_least(grams, n - k + 1)[start]
    return Windows(words, first, text, start, anchor, grams[anchor], mix((sums[start + n] - sums[start]) * down[start]))


def _leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """Where the leftmost least value of each run of `width` values stands; runs are made of runs half as long."""
    at, own, span = np.arange(len(x)), x, 1

    def joined(shift: int) -> tuple[np.ndarray, np.ndarray]:
        right = own[shift:] < own[:-shift]
        return np.where(right, at[shift:], at[:-shift]), np.where(right, own[shift:], own[:-shift])

    while span * 2 <= width:
        at, own = joined(span)
        span *= 2
    return joined(width - span)[0] if width > span else at


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    ids, texts, chars = [], [], 0
    for batch in batches:
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(value.as_py() or "")
            chars += len(texts[-1])
            if chars >= BLOCK_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counted(text: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((text, h))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    values, counts = np.unique(h[new], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.minimum(counts, 2).astype(np.int32))], names=["h", "n"])


def _bit_set(counts: DataFrame) -> np.ndarray:
    """The bit set of all hashes that were counted in two documents or more."""
    members = written(counts.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"))
    bits = PART
    while bits < min(16 * members.count(), MOST_BITS):
        bits *= 2
    parts = bits // PART
    part = F.shiftrightunsigned(F.col("h").bitwiseAND(F.lit(bits - 1)), PART.bit_length() - 1).cast("int")

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.asarray(batch.column(1)).view(np.uint64) & np.uint64(PART - 1)
            which = np.asarray(batch.column(0))
            for p in np.unique(which).tolist():
                x = own.setdefault(p, np.zeros(PART // 8, np.uint8))
                y = at[which == p]
                np.bitwise_or.at(x, y >> np.uint64(3), np.uint8(1) << (y & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([x.tobytes() for x in own.values()], pa.binary())], names=["part", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in members.select(part.alias("part"), "h").repartition(min(parts, 64), "part").mapInArrow(collected, "part int, bits binary").collect():
        out[r["part"] * (PART // 8):(r["part"] + 1) * (PART // 8)] = np.frombuffer(r["bits"], np.uint8)  # MOST_BITS in all
    drop_written(members)
    return out


def _longs(x: np.ndarray) -> bytes:
    return zstandard.compress(np.asarray(x, "<i8").tobytes(), 3)


def _from_longs(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), "<i8")


#: Segments of a bucket: their words, the window count of each, the anchor's offset from the start, shard, least and greatest id.
_BODY = "bucket:int,words:binary,windows:binary,offset:binary,shard:binary,low:binary,high:binary"
_BODY_TYPE = pa.struct([("bucket", pa.int32()), *((c, pa.binary()) for c in ("words", "windows", "offset", "shard", "low", "high"))])
_BLOCK = ("block long, plain_ids array<long>, plain_words array<int>, plain_texts binary, ids array<long>, n_words array<int>, texts binary, "
          f"n_refs array<int>, refs binary, starts binary, buckets binary, segments array<struct<{_BODY}>>")

#: What a solver gets: the segments of a shard as lists of words, each anchor's offset, and the least and greatest id.
#: It returns, for each segment, the least and greatest id of each of its windows over all segments.
Solver = Callable[[list[list[bytes]], list[int], list[int], list[int], int], tuple[list[list[int]], list[list[int]]]]


def _segmented(docs: DataFrame, n: int, k: int, keep_text: bool) -> DataFrame:
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _blocks_of(batches):
            w = windows_of(texts, n, k)
            once = np.ones(len(w.start), bool)
            once[1:] = w.anchor[1:] != w.anchor[:-1]
            yield _counted(w.text[once], w.anchor_hash[once])

    first = spark.sparkContext.broadcast(_bit_set(docs.mapInArrow(anchors, "h long, n int")))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _blocks_of(batches):
            w = windows_of(texts, n, k)
            near = _has(first.value, w.anchor_hash)
            yield _counted(w.text[near], w.hash[near])

    second = spark.sparkContext.broadcast(_bit_set(docs.mapInArrow(windows, "h long, n int")))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for ids, texts in _blocks_of(batches):
            w = windows_of(texts, n, k)
            live = np.flatnonzero(_has(first.value, w.anchor_hash) & _has(second.value, w.hash))
            start, anchor, text = w.start[live], w.anchor[live], w.text[live]
            cut = np.ones(len(live), bool)
            cut[1:] = (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            begin = np.flatnonzero(cut)
            counts = np.diff(np.append(begin, len(live)))
            number: dict[tuple[bytes, int], int] = {}
            bucket, shard, offset, many, low, high, refs = [], [], [], [], [], [], []
            local = (start - w.first[text])[begin].tolist()
            hashes = w.anchor_hash[live][begin]
            for t, at, c, off, b, s in zip(text[begin].tolist(), local, counts.tolist(), (anchor - start)[begin].tolist(),
                                           (hashes % np.uint64(buckets)).tolist(), ((hashes // np.uint64(buckets)) % np.uint64(SHARDS)).tolist(), strict=True):
                key = (b" ".join(w.words[t][at:at + c + n - 1]), off)
                j = number.setdefault(key, len(number))
                doc = ids[t]
                if j == len(bucket):
                    bucket.append(b)
                    shard.append(s)
                    offset.append(off)
                    many.append(c)
                    low.append(HIGHEST)
                    high.append(-HIGHEST)
                if doc is not None:
                    low[j], high[j] = min(low[j], doc), max(high[j], doc)
                refs.append(j)
            names = [x for x, _ in number]
            arrays = [np.array(x, np.int64) for x in (bucket, shard, offset, many, low, high)]
            order = np.argsort(arrays[0], kind="stable")
            bodies = []
            for part in np.split(order, np.flatnonzero(np.diff(arrays[0][order])) + 1):
                if len(part):
                    bodies.append({"bucket": int(arrays[0][part[0]]), "words": pack_words([names[j] for j in part.tolist()]),
                                   "windows": pack_numbers(arrays[3][part]), "offset": pack_numbers(arrays[2][part]), "shard": pack_numbers(arrays[1][part]),
                                   "low": _longs(arrays[4][part]), "high": _longs(arrays[5][part])})
            n_refs = np.bincount(text[begin], minlength=len(ids))
            plain, rest = np.flatnonzero(n_refs == 0).tolist(), np.flatnonzero(n_refs).tolist()
            packed = lambda some: pack_words([b" ".join(w.words[t]) if keep_text else b"" for t in some])  # noqa: B023, E731
            row = {"block": block, "plain_ids": [ids[t] for t in plain], "plain_words": [len(w.words[t]) for t in plain], "plain_texts": packed(plain),
                   "ids": [ids[t] for t in rest], "n_words": [len(w.words[t]) for t in rest], "texts": packed(rest), "n_refs": n_refs[rest].tolist(),
                   "refs": pack_numbers(np.array(refs, np.int64)), "starts": pack_numbers(np.array(local, np.int64)),
                   "buckets": pack_numbers(arrays[0]), "segments": bodies}
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(),
                     pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.list_(_BODY_TYPE)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))
            block += 1

    return written(docs.mapInArrow(segments, _BLOCK))


def _solved(blocks: DataFrame, n: int, solver: Solver) -> DataFrame:
    buckets = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now and rows:
                    yield from solved(rows)
                    rows = []
                now = row["bucket"]
                rows.append(row)
        if rows:
            yield from solved(rows)

    def solved(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, dict[tuple[bytes, int], list[int]]] = {}
        keys = []  # of each row
        for row in rows:
            own = []
            for x, off, shard, low, high in zip(unpack_words(row["words"]), unpack_numbers(row["offset"]).tolist(), unpack_numbers(row["shard"]).tolist(),
                                                _from_longs(row["low"]).tolist(), _from_longs(row["high"]).tolist(), strict=True):
                known = shards.setdefault(shard, {}).setdefault((x, off), [low, high, 0])
                known[0], known[1] = min(known[0], low), max(known[1], high)
                own.append(known)
            keys.append(own)
        answers: list[tuple[list[int], list[int]]] = []
        for shard in shards.values():  # each is a reference of its own: equal windows have equal anchors
            entries = list(shard.items())
            if len(entries) == 1:  # one distinct segment: its own ids are all there is
                (_, e), = entries
                c = entries[0][0][0].count(b" ") + 2 - n
                e[2] = len(answers)
                answers.append(([e[0]] * c, [e[1]] * c))
                continue
            lows, highs = solver([x.split(b" ") for (x, _), _ in entries], [off for (_, off), _ in entries],
                                 [e[0] for _, e in entries], [e[1] for _, e in entries], n)
            for (_, e), low, high in zip(entries, lows, highs, strict=True):
                e[2] = len(answers)
                answers.append((low, high))
        for row, own in zip(rows, keys, strict=True):
            out = [_longs(np.array([v for e in own for v in answers[e[2]][side]], np.int64)) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"]], pa.int64()), pa.array([row["bucket"]], pa.int32()), pa.array([row["windows"]], pa.binary()),
                 *(pa.array([x], pa.binary()) for x in out)], names=["block", "bucket", "windows", "low", "high"])

    asked = blocks.select("block", F.explode("segments").alias("s")).select("block", "s.*")
    return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(solve, "block long, bucket int, windows binary, low binary, high binary")


def covered_words(docs: DataFrame, n: int, k: int, solver: Solver, covers: Callable[[int, np.ndarray, np.ndarray], np.ndarray],
                  keep_text: bool, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_covered, spans, kept): one row for each row of docs.

    covers(doc_id, low, high) says which windows count, from the least and greatest id of all documents they stand in.
    spans are runs of covered words: from, to, from, to ..., end exclusive; kept is the other words joined by spaces,
    or empty without keep_text.  Rows with a null id have no covered words and cover none; null texts have no words.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = _segmented(narrow, n, k, keep_text)
    names, types = ["doc_id", "n_words", "n_covered", "spans", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string()]
    schema = "doc_id long, n_words long, n_covered long, spans array<int>, kept string"

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n_words, texts in zip(*(batch.column(c) for c in range(3)), strict=True):
                ids = ids.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(
                    [ids, n_words.as_py(), [0] * len(ids), [[]] * len(ids), [x.decode() for x in unpack_words(texts.as_py())]], types, strict=True)], names=names)

    def together(block: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        for row in block.to_pylist():
            order = np.argsort(unpack_numbers(row["buckets"]), kind="stable")
            replies = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
            many = np.zeros(len(order), np.int64)
            many[order] = np.concatenate([np.zeros(0, np.int64), *(unpack_numbers(r["windows"]) for r in replies)])
            low, high = (np.concatenate([np.zeros(0, np.int64), *(_from_longs(r[c]) for r in replies)]) for c in ("low", "high"))
            begin = np.zeros(len(order), np.int64)
            begin[order] = np.cumsum(many[order]) - many[order]
            refs, starts, at = unpack_numbers(row["refs"]), unpack_numbers(row["starts"]).astype(np.int64), 0
            for doc_id, words, n_refs, body in zip(row["ids"], row["n_words"], row["n_refs"], unpack_words(row["texts"]), strict=True):
                r, s = refs[at:at + n_refs], starts[at:at + n_refs]
                at += n_refs
                of = _ragged(begin[r], many[r])
                where = _ragged(s, many[r])
                if doc_id is None:
                    where = where[:0]
                else:
                    where = where[covers(doc_id, low[of], high[of])]
                change = np.bincount(where, minlength=words + 1) - np.bincount(where + n, minlength=words + 1)
                inside = np.cumsum(change[:words]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
                own = body.split() if keep_text else []
                kept = b" ".join(w for w, x in zip(own, inside.tolist(), strict=True) if not x) if keep_text else b""
                for column, value in zip(out, (doc_id, words, int(inside.sum()), edges.tolist(), kept.decode()), strict=True):
                    column.append(value)
        return pa.table([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)

    left = blocks.select("block", "ids", "n_words", "texts", "n_refs", "refs", "starts", "buckets").filter(F.size("ids") > 0).groupBy("block")
    right = _solved(blocks, n, solver).groupBy("block")
    return blocks.select("plain_ids", "plain_words", "plain_texts").mapInArrow(plain, schema).unionByName(left.cogroup(right).applyInArrow(together, schema))
