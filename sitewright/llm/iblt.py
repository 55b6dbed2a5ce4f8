"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

A text is cut into paragraphs where its words say so, so that an edit changes only the paragraphs it touches.  A
sketch keeps, in each cell, the number of digests, their XOR and the XOR of their checks.  Subtracting the sketches of
two versions cancels what both have; peeling cells with a single digest recovers what differs.

A fingerprint is the sketch at the size at which it can be peeled by itself, so it grows with the number of paragraphs.
Halves of a sketch add up to the sketch of half the size.  Two fingerprints are compared at a small size first; where
peeling gets stuck, at four times that size, up to their own; where even that is too small, each is peeled by itself.
So the likeness of two texts follows from their fingerprints alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A paragraph ends after a word whose hash is a multiple of 8, and after 32 words at most.
CUT, LONGEST = 8, 32
#: The smallest sketch has 3 times 2 ** BASE cells; comparisons begin with as many and go on in steps of STEP powers.
BASE, STEP = 3, 2
#: Texts are worked on in groups of about so many characters.
GROUP_CHARS = 4_000_000
LOWEST = -(2**63)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _check(x: np.ndarray) -> np.ndarray:
    return (_mix(x + np.uint64(0x51ED270B)) >> np.uint64(32)).astype(np.uint32)


def paragraph_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, digest) of every paragraph; the k-th of equal paragraphs of a text has a digest of its own.

    White space counts as one space, so texts that differ in nothing else have equal paragraphs.
    """
    lists = [t.encode().split() for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    n = int(sizes.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _mix(np.fromiter((xxhash.xxh3_64_intdigest(w) for x in lists for w in x), np.uint64, n))
    text = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(n)
    starts = np.zeros(n, bool)
    starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    starts[1:] |= (h[:-1] % np.uint64(CUT)) == 0
    inside = place - np.maximum.accumulate(np.where(starts, place, 0))
    starts |= inside % LONGEST == 0
    inside %= LONGEST
    powers = np.cumprod(np.full(LONGEST, _ODD[0] | np.uint64(1), np.uint64))
    first = np.flatnonzero(starts)
    digest = _mix(np.add.reduceat((h + np.uint64(1)) * powers[inside], first))
    text = text[first]
    order = np.lexsort((digest, text))
    new = np.ones(len(order), bool)
    new[1:] = (digest[order][1:] != digest[order][:-1]) | (text[order][1:] != text[order][:-1])
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return text[order], _mix(digest[order] + rank.astype(np.uint64) * _ODD[1])


def _cells(owner: np.ndarray, digest: np.ndarray, power: int) -> Iterator[np.ndarray]:
    for j in range(3):
        h = _mix(digest * _ODD[j]) & np.uint64((1 << power) - 1)
        yield owner * (3 << power) + (j << power) + h.astype(np.int64)


class Sketches:
    """As many tables of 3 * 2 ** power cells as there are owners."""

    def __init__(self, owners: int, power: int):
        self.owners, self.power, cells = owners, power, owners * (3 << power)
        self.count, self.key, self.check = np.zeros(cells, np.int32), np.zeros(cells, np.uint64), np.zeros(cells, np.uint32)

    def add(self, owner: np.ndarray, digest: np.ndarray, sign: np.ndarray | int = 1) -> None:
        check = _check(digest)
        for cell in _cells(owner, digest, self.power):
            np.add.at(self.count, cell, sign)
            np.bitwise_xor.at(self.key, cell, digest)
            np.bitwise_xor.at(self.check, cell, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, digest, sign) of what is in the tables, and whether each owner's table came out empty."""
        width, found = 3 << self.power, []
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            look = look[(np.abs(self.count[look]) == 1) & (_check(self.key[look]) == self.check[look])]
            if not len(look):
                break
            owner, digest, sign = look // width, self.key[look], self.count[look]
            order = np.lexsort((digest, owner))
            once = np.ones(len(order), bool)
            once[1:] = (digest[order][1:] != digest[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            owner, digest, sign = owner[order][once], digest[order][once], sign[order][once]
            self.add(owner, digest, -sign)
            found.append((owner, digest, sign))
            look = np.unique(np.concatenate(list(_cells(owner, digest, self.power))))
        empty = ~((self.count != 0) | (self.key != 0)).reshape(self.owners, width).any(axis=1)
        join = lambda k, kind: np.concatenate([np.zeros(0, kind), *(f[k] for f in found)])
        return join(0, np.int64), join(1, np.uint64), join(2, np.int32), empty


class Prints:
    """The fingerprints of texts 0 to owners - 1: number of paragraphs, power, and the tables of each power."""

    def __init__(self, n: np.ndarray, power: np.ndarray, tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.n, self.power, self.tables = n, power, tables  # tables[power]: owners, counts, keys, checks

    @classmethod
    def of(cls, owner: np.ndarray, digest: np.ndarray, owners: int) -> Prints:
        n = np.bincount(owner, minlength=owners)
        power = np.maximum(BASE, np.ceil(np.log2(np.maximum(n, 1) / 2)).astype(np.int64))
        open_, parts = np.arange(owners), {}
        while len(open_):
            stuck = []
            for p in np.unique(power[open_]).tolist():
                mine = open_[power[open_] == p]
                number = np.full(owners, -1)
                number[mine] = np.arange(len(mine))
                own = number[owner] >= 0
                table = Sketches(len(mine), p)
                table.add(number[owner[own]], digest[own])
                kept = [x.reshape(len(mine), -1).copy() for x in (table.count, table.key, table.check)]
                done = table.peel()[3]
                parts.setdefault(p, []).append([mine[done], *(x[done] for x in kept)])
                stuck.append(mine[~done])
            open_ = np.concatenate(stuck)
            power[open_] += 1
        return cls(n, power, {p: tuple(np.concatenate([x[k] for x in some]) for k in range(4)) for p, some in parts.items()})

    @classmethod
    def read(cls, prints: list[str]) -> Prints:
        """The fingerprints that `texts` wrote."""
        split = [x.split(":") for x in prints]
        power, parts = np.array([int(x[1]) for x in split], np.int64), {}
        for i, (_, p, data) in enumerate(split):
            raw, cells = base64.b64decode(data), 3 << int(p)
            parts.setdefault(int(p), []).append((i, np.frombuffer(raw, "<i2", cells), np.frombuffer(raw, "<u8", cells, 2 * cells), np.frombuffer(raw, "<u4", cells, 10 * cells)))
        kinds = (np.int64, np.int32, np.uint64, np.uint32)
        return cls(np.array([int(x[0]) for x in split], np.int64), power,
                   {p: tuple(np.array([x[k] for x in some], kinds[k]) for k in range(4)) for p, some in parts.items()})

    def texts(self) -> list[str]:
        out = [""] * len(self.n)
        for p, (owners, *parts) in self.tables.items():
            count, key, check = (x.astype(kind) for x, kind in zip(parts, ("<i2", "<u8", "<u4"), strict=True))
            for i, owner in enumerate(owners.tolist()):
                data = count[i].tobytes() + key[i].tobytes() + check[i].tobytes()
                out[owner] = f"{self.n[owner]}:{p}:{base64.b64encode(data).decode()}"
        return out

    def taken(self, at: np.ndarray) -> Prints:
        """The fingerprints of the texts with the given numbers, in that order."""
        tables = {}
        for p, (owners, *parts) in self.tables.items():
            place = np.full(len(self.n), -1)
            place[owners] = np.arange(len(owners))
            new = np.flatnonzero(place[at] >= 0)
            tables[p] = (new, *(x[place[at[new]]] for x in parts))
        return Prints(self.n[at], self.power[at], tables)

    def folded(self, power: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, keys and checks of all owners at a size; zeros for those whose own is smaller."""
        out = [np.zeros((len(self.n), 3 << power), kind) for kind in (np.int32, np.uint64, np.uint32)]
        for p, (owners, *parts) in self.tables.items():
            if p >= power and len(owners):
                for k, (x, join) in enumerate(zip(parts, (np.add, np.bitwise_xor, np.bitwise_xor), strict=True)):
                    out[k][owners] = join.reduce(x.reshape(len(owners), 3, 1 << (p - power), 1 << power), axis=2).reshape(len(owners), -1)
        return tuple(out)

    def digests(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, digest) of all paragraphs of some owners, peeled from their own tables."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for p, (owners, count, key, check) in self.tables.items():
            at = np.flatnonzero(np.isin(owners, wanted))
            if len(at):
                table = Sketches(len(at), p)
                table.count, table.key, table.check = count[at].ravel().copy(), key[at].ravel().copy(), check[at].ravel().copy()
                o, d, _, _ = table.peel()
                found.append((owners[at][o], d))
        return tuple(np.concatenate([f[k] for f in found]) for k in range(2))


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """Shared paragraphs of each pair as a share of all different ones of both sides; 1 where both sides have none."""
    pairs = len(a.n)
    apart, open_ = np.zeros(pairs, np.int64), np.arange(pairs)
    least, power = np.minimum(a.power, b.power), BASE
    while len(open_) and power <= least[open_].max():
        able = open_[least[open_] >= power]
        table = Sketches(len(able), power)
        (ca, ka, xa), (cb, kb, xb) = a.folded(power), b.folded(power)
        table.count, table.key, table.check = (ca[able] - cb[able]).ravel(), (ka[able] ^ kb[able]).ravel(), (xa[able] ^ xb[able]).ravel()
        owner, _, _, done = table.peel()
        apart[able] = np.bincount(owner, minlength=len(able))
        open_, power = np.concatenate([open_[least[open_] < power], able[~done]]), power + STEP
    if len(open_):
        both = [np.rec.fromarrays(x.digests(open_), names="owner,digest") for x in (a, b)]
        apart[open_] = np.bincount(np.setxor1d(*both)["owner"], minlength=pairs)[open_]
    total = a.n + b.n
    return np.where(total > 0, (total - apart) / np.maximum(total + apart, 1), 1.0)


def prints_of_following(texts: list[str], follow: list[str]) -> tuple[Prints, Prints]:
    """Fingerprints of texts and of the texts that follow them; one that follows as the very next text is read once."""
    every, at = list(texts), []
    for i, text in enumerate(follow):
        known = i + 1 < len(texts) and text is texts[i + 1]
        at.append(i + 1 if known else len(every))
        if not known:
            every.append(text)
    prints = Prints.of(*paragraph_digests(every), len(every))
    return prints.taken(np.arange(len(texts))), prints.taken(np.array(at, np.int64))


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, extra, doc_id, text): the documents by descending id in blocks, each block followed by the first
    document of the next one, and the last block by the first of all.

    Nulls come last, equal ids are ordered by their texts.  Block borders are quantiles of the ids, as many as the
    session has shuffle partitions; only borders and each block's first id go to the driver.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                        F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)).alias("k"))
    cuts = keyed.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    borders = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def block_of(k: pd.Series) -> pd.Series:
        return pd.Series(len(borders) - np.searchsorted(borders, k.to_numpy(np.int64), side="left")).astype("int32")

    firsts = sorted((r[0], r[1]) for r in keyed.select(block_of("k").alias("b"), "k").groupBy("b").agg(F.max("k")).collect())
    target = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def blocks_of(k: pd.Series) -> pd.Series:
        own = (len(borders) - np.searchsorted(borders, k.to_numpy(np.int64), side="left")).tolist()
        return pd.Series([[b, target[x]] if x in target else [b] for b, x in zip(own, k.tolist(), strict=True)])

    placed = keyed.withColumn("b", blocks_of("k")).select("doc_id", "text", "k", F.posexplode("b").alias("extra", "block"))
    return placed.repartition(n, "block").sortWithinPartitions(
        "block", "extra", F.desc("k"), F.xxhash64("text"), "text").select("block", "extra", "doc_id", "text")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document, whose edited text is the text with its last half replaced by the start of the next
    document's: doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next (likeness, 0 to 1).

    Both likenesses are those of the fingerprints, see `likeness`.  A null text counts as empty; repeated rows follow
    each other; a single document follows itself.
    """
    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, chars, last = [], 0, None

        def results() -> pa.RecordBatch:
            ids, texts, follow = zip(*group, strict=True)
            edited = [t[:len(t) - len(t) // 2] + f[:len(t) // 2] for t, f in zip(texts, follow, strict=True)]
            own, after = prints_of_following(texts, follow)
            new = Prints.of(*paragraph_digests(edited), len(ids))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(edited, pa.string()),
                 *(pa.array(x.texts(), pa.string()) for x in (own, new)), *(pa.array(likeness(own, x)) for x in (new, after))],
                names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for block, extra, doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                value = value.as_py()
                if last is not None and last[0] == block:
                    group.append((last[1], last[2], value))
                    chars += len(last[2]) + len(value)
                    if chars >= GROUP_CHARS:
                        yield results()
                        group, chars = [], 0
                    if extra:
                        last = None
                        continue
                last = None if extra else (block, doc_id, value)
        if group:
            yield results()

    return neighbours(docs, key, text).mapInArrow(
        edits, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
