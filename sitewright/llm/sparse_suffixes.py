"""Repeated passages by sparse suffix arrays.

Only suffixes at anchors (minimisers of the word windows) are kept.  The suffixes of a shard are sorted by their words
from the anchor on, ties by the words before it read backwards; neighbours are compared, and a match is extended to
the right and to the left of the anchor.  Whatever a neighbour confirms passes along the sorted array in two sweeps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.repeats import covered_words

MIN_WORDS = 50
ANCHOR_WORDS = 8


def common_prefix(a: list[bytes], b: list[bytes]) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def solve(segments: list[list[bytes]], offsets: list[int], lows: list[int], highs: list[int], n: int) -> tuple[list[list[int]], list[list[int]]]:
    count = [len(s) - n + 1 for s in segments]
    low, high = [[x] * c for x, c in zip(lows, count, strict=True)], [[x] * c for x, c in zip(highs, count, strict=True)]
    right = [s[o:] for s, o in zip(segments, offsets, strict=True)]
    left = [s[:o][::-1] for s, o in zip(segments, offsets, strict=True)]
    array = sorted(range(len(segments)), key=lambda i: (right[i], left[i]))
    # windows that two neighbours share start at most `back` words before the anchor and end at most `ahead` after it
    shared = []
    for i, j in zip(array, array[1:]):
        back, ahead = common_prefix(left[i], left[j]), common_prefix(right[i], right[j])
        starts = range(offsets[i] - back, min(offsets[i], offsets[i] + ahead - n) + 1)
        shared.append((i, j, starts, offsets[j] - offsets[i]))
    for sweep in (shared, [(j, i, range(r.start + d, r.stop + d), -d) for i, j, r, d in reversed(shared)]):
        for i, j, starts, shift in sweep:
            for s in starts:
                low[j][s + shift] = min(low[j][s + shift], low[i][s])
                high[j][s + shift] = max(high[j][s + shift], high[i][s])
    # windows that no neighbour confirmed: equal ones may lie further apart in the array
    alone: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
    for i, words in enumerate(segments):
        for s in range(count[i]):
            if low[i][s] >= high[i][s]:
                alone.setdefault(tuple(words[s:s + n]), []).append((i, s))
    if alone:
        for i, words in enumerate(segments):
            for s in range(count[i]):
                places = alone.get(tuple(words[s:s + n]))
                if places and places[0] != (i, s):
                    a, b = places[0]
                    low[a][b], high[a][b] = min(low[a][b], low[i][s]), max(high[a][b], high[i][s])
        for places in alone.values():
            a, b = places[0]
            for i, s in places[1:]:
                low[i][s], high[i][s] = low[a][b], high[a][b]
    return low, high


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_repeated, spans): words that lie in a run of min_words or more words which also stands, in
    this order, in a document with another id.  spans: from, to, from, to ... by word, end exclusive.

    One row for each row of docs.  Rows of one id don't count against each other; rows with a null id have no spans
    and give none to others; a null text has no words.
    """
    found = covered_words(docs, min_words, min(ANCHOR_WORDS, min_words), solve,
                          lambda doc_id, low, high: (low != np.int64(doc_id)) | (high != np.int64(doc_id)), False, key, text)
    return found.select("doc_id", "n_words", F.col("n_covered").alias("n_repeated"), "spans")
