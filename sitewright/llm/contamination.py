"""Benchmark passages in a corpus, by a positional inverted index kept in document-partitioned segments.

`build_index` writes one row for each segment of about SEGMENT_WORDS words: its documents, its terms and, for each
term, the sorted places where it stands.  `search` takes the windows of the benchmark against every segment: the list
of a window's rarest term over the whole corpus is shifted by the term's offset and intersected with the shifted lists
of the next rarest terms until all have agreed.  Phrases lie inside a document, so segments need no exchange.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import written

WINDOW = 10
#: A proximity match has all words of a window within so many words of its rarest one, in any order.
NEAR = 30
SEGMENT_WORDS = 400_000
#: Benchmark texts are sent to the tasks in blocks of about so many bytes, one pass over the index for each block.
BLOCK_BYTES = 32 << 20
#: Candidates that are looked at in one step.
STEP = 1_000_000
# Words are runs of digits, letters and non-ASCII characters; A-Z count as a-z.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = ("segment long, doc_ids array<long>, n_words array<int>, terms array<binary>, n_places array<int>, places binary")
FOUND = ("segment long, doc int, doc_id long, n_words long, n_hit long, hits array<int>, items array<long>, near_items array<long>")


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(PLAIN).split() if text else []


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index as a written table.  Null texts are documents without words; ids may be null or repeated."""
    from pyspark import TaskContext

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 32) + np.int64(0)
        ids, sizes, all_words, made = [], [], [], 0

        def segment() -> pa.RecordBatch:
            numbers = defaultdict(count().__next__)
            codes = np.fromiter(map(numbers.__getitem__, all_words), np.int32, len(all_words))
            places = np.argsort(codes, kind="stable").astype("<i4")
            columns = [pa.array([int(number) + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                       pa.array([list(numbers)], pa.list_(pa.binary())),
                       pa.array([np.bincount(codes, minlength=len(numbers)).astype(np.int32)], pa.list_(pa.int32())), pa.array([places.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["segment", "doc_ids", "n_words", "terms", "n_places", "places"])

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(value)
                ids.append(doc_id)
                sizes.append(len(found))
                all_words += found
                if len(all_words) >= SEGMENT_WORDS or len(ids) >= SEGMENT_WORDS:
                    yield segment()
                    ids, sizes, all_words, made = [], [], [], made + 1
        if ids:
            yield segment()

    return written(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(segments, INDEX))


def term_counts(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """How often each of the terms stands in the corpus; reads no places."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = defaultdict(int)
        for batch in batches:
            for own, n in zip(batch.column(0), batch.column(1), strict=True):
                for term, x in zip(own.as_py(), n.as_py(), strict=True):
                    if term in terms:
                        total[term] += x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    found = index.select("terms", "n_places").mapInArrow(counts, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in found.collect()}  # at most one row for each term of the benchmark block


def query_windows(items: list[tuple[int | None, str | None]], window: int) -> dict[tuple[bytes, ...], set[int]]:
    """The distinct windows and the items that they come from."""
    out: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
    for item, value in items:
        own = words(value)
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            out[tuple(own[i:i + n])].add(item)
    return out


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, starts[1] .., in one array."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


def _search_block(index: DataFrame, items: list[tuple[int, str]], window: int, near: int) -> DataFrame:
    queries = query_windows(items, window)
    vocabulary = {t: k for k, t in enumerate(sorted({t for q in queries for t in q}))}
    total = term_counts(index, set(vocabulary))
    n_q, width = len(queries), max(map(len, queries), default=1)
    length = np.array([len(q) for q in queries], np.int64)
    term = np.full((n_q, width), -1, np.int64)
    offset = np.zeros((n_q, width), np.int64)
    for k, q in enumerate(queries):  # rarest first
        order = sorted(range(len(q)), key=lambda i: (total.get(q[i], 0), i))
        offset[k, :len(q)] = order
        term[k, :len(q)] = [vocabulary[q[i]] for i in order]
    item_list = [sorted(x for x in s if x is not None) for s in queries.values()]
    item_from = np.cumsum([0, *map(len, item_list)])
    item_ids = np.array([x for s in item_list for x in s], np.int64)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield in_segment(*(batch.column(c)[r] for c in range(6)))

    def in_segment(segment, doc_ids, n_words, terms, n_places, places) -> pa.RecordBatch:
        sizes = np.asarray(n_words.values, np.int64)
        docs = len(sizes)
        ends = np.cumsum(sizes)
        begins, n = ends - sizes, int(ends[-1]) if docs else 0
        spot = np.frombuffer(places.as_py(), "<i4").astype(np.int64)
        own_n = np.asarray(n_places.values, np.int64)
        own_from = np.cumsum(own_n) - own_n
        known = np.full(len(vocabulary), -1, np.int64)
        for k, t in enumerate(terms.as_py()):
            v = vocabulary.get(t)
            if v is not None:
                known[v] = k
        here = np.flatnonzero(known >= 0)
        lists_n = np.zeros(len(vocabulary), np.int64)
        lists_n[here] = own_n[known[here]]
        postings = spot[_ragged(own_from[known[here]], own_n[known[here]])] if len(here) else spot[:0]
        lists_from = np.cumsum(lists_n) - lists_n
        at = np.full(n + width, -1, np.int64)  # the postings turned round: which benchmark term stands at a place
        at[postings] = np.repeat(here, lists_n[here])
        keyed = np.repeat(here, lists_n[here]) * (n + 1) + postings
        doc_of = np.repeat(np.arange(docs), sizes)
        change = np.zeros(n + 1, np.int64)
        pairs, near_pairs = [], []
        live = np.flatnonzero(((term < 0) | (lists_n[np.maximum(term, 0)] > 0)).all(axis=1)) if len(vocabulary) else np.zeros(0, np.int64)
        load = np.cumsum(lists_n[term[live, 0]]) if len(live) else live
        cuts = np.searchsorted(load, np.arange(STEP, (load[-1] if len(live) else 0) + STEP, STEP), side="left") + 1
        for some in np.split(live, np.unique(cuts)[:-1] if len(cuts) else []) if len(live) else []:
            rare = term[some, 0]
            q = np.repeat(some, lists_n[rare])
            p = postings[_ragged(lists_from[rare], lists_n[rare])]
            exact_q, start = q, p - offset[q, 0]
            for k in range(1, width):  # shifted lists, from the rarest on
                ok = (start >= 0) & (start + length[exact_q] <= n)
                exact_q, start = exact_q[ok], start[ok]
                ok = (term[exact_q, k] < 0) | (at[start + offset[exact_q, k]] == term[exact_q, k])
                exact_q, start = exact_q[ok], start[ok]
            ok = (start >= 0) & (start + length[exact_q] <= n)
            exact_q, start = exact_q[ok], start[ok]
            ok = doc_of[start] == doc_of[start + length[exact_q] - 1]
            exact_q, start = exact_q[ok], start[ok]
            np.add.at(change, start, 1)
            np.add.at(change, start + length[exact_q], -1)
            pairs.append((doc_of[start], exact_q))
            if near:
                d = doc_of[p]
                low, high = np.maximum(p - near, begins[d]), np.minimum(p + near, ends[d] - 1)
                for k in range(1, width):
                    ok = term[q, k] < 0
                    first = np.searchsorted(keyed, term[q, k] * (n + 1) + low)
                    ok |= (first < len(keyed)) & (keyed[np.minimum(first, len(keyed) - 1)] <= term[q, k] * (n + 1) + high)
                    q, low, high, d = q[ok], low[ok], high[ok], d[ok]
                near_pairs.append((d, q))
        hit = np.concatenate([[0], np.cumsum(np.cumsum(change[:n]) > 0)])
        n_hit = hit[ends] - hit[begins]
        edges = np.diff(np.concatenate([[0], (np.cumsum(change[:n]) > 0).astype(np.int8), [0]]))
        from_, to = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        ranges: list[list[int]] = [[] for _ in range(docs)]
        for a, b in zip(from_.tolist(), to.tolist(), strict=True):
            while a < b:  # a run of hit words may go over the end of a document
                d = int(doc_of[a])
                ranges[d] += [a - int(begins[d]), min(b, int(ends[d])) - int(begins[d])]
                a = int(ends[d])
        lists = [listed(x, docs) for x in (pairs, near_pairs)]
        return pa.RecordBatch.from_arrays(
            [pa.array([segment.as_py()] * docs, pa.int64()), pa.array(range(docs), pa.int32()), pa.array(doc_ids.as_py(), pa.int64()), pa.array(sizes, pa.int64()),
             pa.array(n_hit, pa.int64()), pa.array(ranges, pa.list_(pa.int32())), *(pa.array(x, pa.list_(pa.int64())) for x in lists)],
            names=["segment", "doc", "doc_id", "n_words", "n_hit", "hits", "items", "near_items"])

    def listed(found: list[tuple[np.ndarray, np.ndarray]], docs: int) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(docs)]
        if found:
            both = np.unique(np.concatenate([d for d, _ in found]) * max(n_q, 1) + np.concatenate([q for _, q in found]))
            d, q = both // max(n_q, 1), both % max(n_q, 1)
            sizes = item_from[q + 1] - item_from[q]
            for x, item in zip(np.repeat(d, sizes).tolist(), item_ids[_ragged(item_from[q], sizes)].tolist() if len(q) else [], strict=True):
                out[x].append(item)
        return [sorted(set(x)) for x in out]

    return index.select("segment", "doc_ids", "n_words", "terms", "n_places", "places").mapInArrow(find, FOUND)


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int = NEAR, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each indexed document: segment, doc (its number there), doc_id, n_words, n_hit (words inside an
    occurrence of a window), hits (from, to, from, to ...: runs of hit words, end exclusive), items and near_items
    (ids with an exact window, and with a window by proximity; sorted).

    A benchmark of any size is searched in blocks of bounded size.  Null texts and items without words have no
    window; words of items with null ids are hit, but such items are in no list; an empty benchmark hits nothing.
    """
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    parts = [_search_block(index, [(r["item"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()], window, near)
             for b in range(blocks)]
    if blocks == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    joined = every.groupBy("segment", "doc", "doc_id", "n_words").agg(
        F.flatten(F.collect_list("hits")).alias("hits"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")])
    covered = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2)), lambda i: F.sequence(
        F.get("hits", i), F.get("hits", i + 1) - 1))))
    return joined.withColumn("n_hit", F.when(F.size("hits") > 0, F.size(covered)).otherwise(0).cast("long")).select(*parts[0].columns)
