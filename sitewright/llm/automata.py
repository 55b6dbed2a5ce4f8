"""Substring dedup by suffix automata of reference shards.

A shard is what the documents' repeated segments with anchors of one hash class hold; its suffix automaton carries, in
each state, the least document id of all places that end there.  Segments are streamed through the automaton for
their matching statistics; a window goes when the state of its words has an id smaller than the document's own.

The method's broadcast of every shard to every document would make work grow with the square of the corpus.  Equal
windows have equal anchors, so each segment needs one shard only, and both meet by a hash exchange.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.repeats import HIGHEST, covered_words

MIN_WORDS = 13
ANCHOR_WORDS = 5


class SuffixAutomaton:
    """Of many word sequences; `least` is the smallest number given with a sequence that holds the state's words."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [HIGHEST]

    def _state(self, length: int, following: dict[bytes, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.least.append(HIGHEST)
        return len(self.length) - 1

    def _split(self, at: int, word: bytes) -> int:
        """The state reached from `at` by `word`, made one word longer than `at`."""
        to = self.next[at][word]
        if self.length[to] == self.length[at] + 1:
            return to
        copy = self._state(self.length[at] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, words: list[bytes], number: int) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word)
            else:
                new, at = self._state(self.length[last] + 1, {}, 0), last
                while at >= 0 and word not in self.next[at]:
                    self.next[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    self.link[new] = self._split(at, word)
                last = new
            self.least[last] = min(self.least[last], number)

    def settle(self) -> None:
        """Hands every state's number on to the states of its suffixes; once, after the last sequence."""
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            up = self.link[state]
            self.least[up] = min(self.least[up], self.least[state])

    def matches(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Matching statistics: after each word, the length of the longest suffix that a sequence holds, and its state."""
        state, length, out = 0, 0, []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            out.append((length, state))
        return out

    def least_of_suffix(self, state: int, length: int) -> int:
        """The number of the last `length` words of a match at least as long that ended in `state`."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return self.least[state]


def solve(segments: list[list[bytes]], offsets: list[int], lows: list[int], highs: list[int], n: int) -> tuple[list[list[int]], list[list[int]]]:
    reference = SuffixAutomaton()
    for words, low in zip(segments, lows, strict=True):
        reference.add(words, low)
    reference.settle()
    found = [[reference.least_of_suffix(state, n) if length >= n else HIGHEST for length, state in reference.matches(words)[n - 1:]] for words in segments]
    return found, found


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept): the documents without words that lie in a run of min_words or more
    words which also stand, in this order, in a document with a smaller id.

    One row for each row of docs.  Rows of one id don't count against each other; a null id keeps all and removes
    nothing elsewhere; a null text has no words; texts shorter than min_words are kept.  removed: from, to, ... by word.
    """
    found = covered_words(docs, min_words, min(ANCHOR_WORDS, min_words), solve, lambda doc_id, low, high: low < np.int64(doc_id), True, key, text)
    return found.select("doc_id", "n_words", F.col("n_covered").alias("n_removed"), F.col("spans").alias("removed"), "kept")
