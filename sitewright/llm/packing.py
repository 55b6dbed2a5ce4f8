"""Best-fit packing of token sequences, with proven lower bounds on the number of bins.

Pieces are dealt into groups of bounded size.  Each group is packed by best-fit decreasing, and dual feasible functions
give a bound that no packing of the group can beat.  Groups that meet their bound are done but for their loosest bin;
groups with a gap hand over all bins that have room.  What was handed over is dealt anew in whole bins and packed again,
and the new packing counts only where it needs fewer bins, so the number of sequences never grows.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import written

#: Pieces of one group; a group is packed by one call, whatever the size of the input.
GROUP_PIECES = 8192
#: Rounding functions tried for the bound, each together with every threshold.
ROUNDINGS = 32
#: An exchange is followed by another while it saves one of so many bins.
WORTH = 1000
#: Distinct words, and parts of words, whose ids a task remembers; beyond it the memory is emptied, which costs time only.
REMEMBERED = 600_000
#: Long texts are read in parts of about so many characters.
PART_CHARS = 1_000_000


def bin_bound(counts: np.ndarray, capacity: int) -> int:
    """The largest lower bound on bins that the dual feasible functions prove; counts[l] pieces have length l.

    With x = l / capacity the functions are the identity and x -> floor((k + 1) x) / k (x itself where (k + 1) x is
    whole), each after a threshold e: lengths over capacity - e count as a whole bin, those under e as nothing.
    """
    counts = np.asarray(counts, np.int64)
    length = np.arange(capacity + 1, dtype=np.int64)
    e = np.arange(capacity // 2 + 1)
    more = counts.sum() - np.cumsum(counts)[capacity - e]
    best = 0
    for k in range(ROUNDINGS + 1):
        scale = max(k, 1) * capacity
        value = length if k == 0 else np.where((k + 1) * length % capacity == 0, length * k, (k + 1) * length // capacity * capacity)
        upto = np.concatenate([[0], np.cumsum(value * counts)])
        total = more * scale + upto[capacity - e + 1] - upto[e]
        best = max(best, int(-(-total.max() // scale)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: longest first, each into the fullest bin that has room; ties by place."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(room, (size, -1))
        free, b = room.pop(at) if at < len(room) else (capacity, made)
        made += b == made
        bins[i], offsets[i] = b, capacity - free
        if free > size:
            insort(room, (free - size, b))
    return bins, offsets


def _repacked(capacity: int, stage: int) -> Callable[[pa.Table], pa.Table]:
    """Packs the rows of one group; `_open` marks the bins that go on to the next exchange."""
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        lengths = table.column("length").to_numpy().astype(np.int64)
        group = int(table.column("_group")[0].as_py())
        bound = bin_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        ids = (stage << 56) + (group << 20) + bins
        before = table.column("sequence_id").to_numpy()
        old, place = np.unique(before, return_inverse=True)
        if stage and bins.max() + 1 >= len(old):  # nothing won: the old bins stay
            bins, ids, offsets = place, before, table.column("offset").to_numpy()
        filled = np.bincount(bins, lengths).astype(np.int64)
        open_bins = filled < capacity
        if len(filled) == bound:  # proven; only the last bin may still be shared with other groups
            open_bins &= np.arange(len(filled)) == filled.argmin()
        for name, column in (("sequence_id", ids), ("offset", offsets), ("_open", open_bins[bins])):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(column))
        return table

    return pack


class Packed(NamedTuple):
    """placed has the given rows with sequence_id and offset; bound is proven: no packing has fewer sequences."""

    placed: DataFrame
    sequences: int
    bound: int


def pack(pieces: DataFrame, capacity: int = 4096, length: str = "length") -> Packed:
    """Gives each row of pieces a sequence_id (long) and an offset there, so that no sequence exceeds the capacity.

    Lengths must be from 1 to the capacity; a row without one is an error.  Columns of pieces stay; own columns
    named sequence_id or offset are replaced.  Repeated rows are pieces of their own, an empty table gives none.  Rows
    go by a number of their own, so no key or length gathers in one task.
    """
    spark = pieces.sparkSession
    boxed = pieces.select(F.struct(*[c for c in pieces.columns if c not in ("sequence_id", "offset")]).alias("row"), F.col(length).cast("long").alias("length"))
    checked = boxed.withColumn("length", F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(
        F.raise_error(F.lit(f"lengths must be from 1 to {capacity}")).cast("long")))
    rows = written(checked.withColumn("_row", F.monotonically_increasing_id()))
    by_length = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in by_length.items():
        counts[size] = n
    bound = bin_bound(counts, capacity)
    whole = rows.filter(F.col("length") == capacity).select("row", (F.lit(1 << 62) + F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, sequences = [whole], int(counts[capacity])
    rest = rows.filter(F.col("length") < capacity).select(
        "row", "length", "_row", F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("_open"))
    n_open, open_bins, stage = int(counts[:capacity].sum()), None, 0
    while n_open:
        groups = -(-n_open // GROUP_PIECES)
        dealt = rest.withColumn("_group", F.pmod(F.xxhash64("sequence_id", F.lit(stage)), F.lit(groups)))
        packed = written(dealt.groupBy("_group").applyInArrow(_repacked(capacity, stage), dealt.schema))
        now = {r["_open"]: (r.bins, r.n) for r in packed.groupBy("_open").agg(F.countDistinct("sequence_id").alias("bins"), F.count("*").alias("n")).collect()}
        closed, (bins, n_open) = now.get(False, (0, 0))[0], now.get(True, (0, 0))
        won = open_bins is None or (open_bins - closed - bins) * WORTH >= open_bins
        if groups == 1 or not won or sequences + closed + bins <= bound:  # nothing left to exchange, to win, or to prove
            done.append(packed.select("row", "sequence_id", "offset"))
            sequences += closed + bins
            break
        done.append(packed.filter("NOT _open").select("row", "sequence_id", "offset"))
        rest, sequences, open_bins, stage = packed.filter("_open").drop("_group"), sequences + closed, bins, stage + 1
    placed = done[0]
    for part in done[1:]:
        placed = placed.unionByName(part)
    return Packed(placed.select("row.*", "sequence_id", "offset"), sequences, bound)


#: Characters whose normal form, small letter and class are the same in Python and in the tokenizer; the rest is left to it.
PLAIN = r"[\t-\r\x20-\x7e\xa1-įı-ſ]"
#: The splitting pattern of the vocabulary (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _visible_bytes() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Remembered(dict):
    """The values of a function, computed when first asked for."""

    def __init__(self, function: Callable[[str], bytes]):
        super().__init__()
        self.function = function

    def __missing__(self, key: str) -> bytes:
        self[key] = value = self.function(key)
        return value


class WordEncoder:
    """Ids of whole texts, four bytes each, as the tokenizer gives them; equal words are encoded once while remembered.

    White space is dropped by the tokenizer and no token crosses it, so words are encoded apart.  Words of plain
    characters need only its merges; all others go through it as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.tokenize = self.whole.model.tokenize
        self.visible = _visible_bytes()
        self.split, self.odd = regex.compile(SPLIT), re.compile(PLAIN.replace("[", "[^", 1))
        self.words, self.parts = Remembered(self.word), Remembered(self.part)

    def part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.visible)
        ids = [t.id for t in self.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        if self.odd.search(word):
            return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        word = word.lower()
        return self.parts[word] if word.isalpha() else b"".join(map(self.parts.__getitem__, self.split.findall(word)))

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids, part by part; a part ends at white space."""
        at = 0
        while at < len(text):
            space = _SPACE.search(text, at + PART_CHARS)
            end = space.end() if space else len(text)
            part = text if end - at == len(text) else text[at:end]
            at = end
            for memory in (self.words, self.parts):
                if len(memory) > REMEMBERED:
                    memory.clear()
            # small letters first where that is safe for the whole part, so that fewer words differ
            words = _SPACE_RUN.split(part) if self.odd.search(part) else part.lower().split()
            yield b"".join(map(self.words.__getitem__, words))


_SPACE, _SPACE_RUN = re.compile(r"[\t-\r ]"), re.compile(r"[\t-\r ]+")


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1,
                 with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document's ids: key, piece (int), start, length (long), ids_crc32 (long), ids (binary).

    A document is its ids and end_id; a null text is an empty one.  Only documents over the capacity are cut.  Ids are
    little-endian unsigned 32-bit integers.  Keys may be null, repeated and of any type; other columns are left out.
    """
    chunk = 4 * capacity
    kind = docs.schema[key].dataType.simpleString()
    last = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        for batch in batches:
            rows, piece, start, size, crc, kept = [], [], [], [], [], []

            def add(row: int, n: int, ids: bytes) -> None:
                rows.append(row)
                piece.append(n)
                start.append(n * capacity)
                size.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                kept.append(ids if with_ids else None)

            for i, x in enumerate(batch.column(1)):
                left, n = b"", 0
                for more in encoder.encode(x.as_py() or ""):
                    left += more
                    whole = len(left) // chunk if len(left) % chunk else len(left) // chunk - 1
                    for at in range(max(whole, 0)):
                        add(i, n, left[at * chunk:(at + 1) * chunk])
                        n += 1
                    left = left[max(whole, 0) * chunk:]
                left += last
                for at in range(0, len(left), chunk):
                    add(i, n, left[at:at + chunk])
                    n += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(kept, pa.binary())],
                names=["key", "piece", "start", "length", "ids_crc32", "ids"])

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return narrow.mapInArrow(cut, f"key {kind}, piece int, start long, length long, ids_crc32 long, ids binary").withColumnRenamed("key", key)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of packed pieces that carry their ids; a sequence has at most its capacity of them."""
    parts = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", "length", F.concat(F.lit(b""), F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))")).alias("ids"))
