"""Pivot-table clustering and certified packing against plain versions."""

import hashlib
import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
import zlib
from tokenizers import Tokenizer

from sitewright.llm import packing, pivot_clusters, queries

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain_clusters(rows, clusters=40, rounds=5):
    kept = [(i, [min(max(math.floor(256 * float(x)), -(1 << 27)), 1 << 27) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, at) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, *nearest(v)[::-1]) for i, v in kept], centroids


def key(row):
    return tuple((x is not None, x) for x in row)


def checked(spark, rows, folder):
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'own' as cluster", "'own' as v", "'own' as key").write.parquet(f"{folder}/embeddings.parquet")
    got = queries.op12_laesa_clusters(spark, str(folder)).collect()
    want, centroids = plain_clusters(rows)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    for r in got:
        assert r.centroid_sha256 == digests[r.cluster]
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for *_, d in want)


def test_clusters_of_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(90)]
    rows += [(3, rows[5][1]), (None, rows[6][1]), (None, None), (200, []), (201, [1.0] * 63), (202, [1.0] * 65), (203, [None] + [1.0] * 63),
             (204, [math.nan] + [1.0] * 63), (205, [-math.inf] + [1.0] * 63), (206, [1e30] * 32 + [-1e30] * 32)] + [(300 + i, rows[0][1]) for i in range(60)]
    checked(spark, rows, tmp_path / "a")
    checked(spark, rows[:7], tmp_path / "b")
    checked(spark, [], tmp_path / "c")


def test_clusters_of_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want, _ = plain_clusters(rows)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in queries.op12_laesa_clusters(spark, SMALL).collect()) == sorted(want)


def test_pivots_spare_distances_and_miss_none():
    rng = np.random.default_rng(2)
    centres = rng.integers(-20000, 20000, (40, 64))
    vectors = centres[rng.integers(0, 40, 3000)] + rng.integers(-300, 300, (3000, 64))
    pivots = pivot_clusters.spread_pivots(centres, 8)
    to_pivots = np.sqrt(((vectors[:, None] - pivots[None]) ** 2).sum(axis=2).astype(float))
    c, d, tried = pivot_clusters.nearest(vectors, to_pivots, centres, pivots)
    all_d = ((vectors[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (c == all_d.argmin(axis=1)).all() and (d == all_d.min(axis=1)).all()
    assert tried < 0.2 * all_d.size
    wrong = pivot_clusters.nearest(vectors, np.roll(to_pivots, 1, axis=0), centres, pivots)[0]  # the table decides
    assert len(wrong) != len(c) or (wrong != c).any()


def fewest_bins(lengths, capacity):
    """The least number of bins, by search."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1:])
        place(i + 1, bins + [lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_bounds_hold():
    rng = random.Random(5)
    better = 0
    for _ in range(150):
        capacity = rng.choice([10, 13, 24])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        bound = packing.bin_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        bins, offsets = packing.best_fit_decreasing(np.array(lengths), capacity)
        assert -(-sum(lengths) // capacity) <= bound <= fewest_bins(lengths, capacity) <= bins.max() + 1
        better += bound > -(-sum(lengths) // capacity)
        for b in set(bins.tolist()):
            at = 0
            for offset, size in sorted((o, n) for o, n, x in zip(offsets.tolist(), lengths, bins.tolist()) if x == b):
                assert offset == at
                at += size
            assert at <= capacity
    assert better > 10
    assert packing.bin_bound(np.bincount([51] * 7, minlength=101), 100) == 7
    assert packing.bin_bound(np.zeros(101, int), 100) == 0


def check_places(rows, capacity):
    """Gapless sequences within the capacity; how many there are."""
    found = {}
    for sequence, offset, length in rows:
        found.setdefault(sequence, []).append((offset, length))
    for parts in found.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(found)


@pytest.mark.parametrize("group", [8192, 40])
def test_packing_is_whole_and_certified(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_PIECES", group)
    rng = random.Random(7)
    lengths = [rng.choice([1, 1, 5, 30, 33, 34, 50, 51, 66, 99, 100]) for _ in range(1500)]
    rows = [(i % 5, n, "own") for i, n in enumerate(lengths)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, length long, sequence_id string"), 100)
    got = found.placed.collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((a, b) for a, b, _ in rows)
    assert check_places([(r.sequence_id, r.offset, r.length) for r in got], 100) == found.sequences
    assert found.bound <= found.sequences <= found.bound + (0 if group > 1500 else found.bound // 100)
    in_groups = [lengths[at::38] for at in range(38)]  # packed apart, without an exchange
    assert group > 1500 or found.sequences < sum(packing.best_fit_decreasing(np.array(x), 100)[0].max() + 1 for x in in_groups)
    assert packing.pack(spark.createDataFrame([], "length long"), 100).placed.count() == 0
    with pytest.raises(Exception, match="lengths must be"):
        packing.pack(spark.createDataFrame([(101,)], "length long"), 100).placed.collect()


ODD = [(1, None), (2, ""), (2, ""), (None, "x y z"), (None, None), (4, "Word's 'S DON'T " * 9000), (5, "İstanbul ŉ Σίσυφος ΟΔΟΣ,\x1c\x85\xa0a　b é <|endoftext|> don't"),
       (6, "ﬁ ½ ²ª ǅ ſ K Å 中文 😀 \x00"), (7, "x" * 5000), (8, "a " * 4095), (9, "a " * 4096), (10, "a " * 8191)]


def token_ids():
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_documents_are_packed_as_the_tokenizer_reads_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "PART_CHARS", 300)
    rows = ODD + [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'own' as piece", "'own' as row", "'own' as length", "'own' as key").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_certified_packing(spark, str(tmp_path)).collect()
    ids_of, want = token_ids(), []
    for doc, text in rows:
        ids = ids_of(text)
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at:at + 4096], "<u4").tobytes()
            want.append((doc, n, at, len(part) // 4, zlib.crc32(part)))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    assert check_places([(r.sequence_id, r.offset, r.length) for r in got], 4096) == got[0].sequences == got[0].bound


def test_sequences_hold_the_ids(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    found = packing.pack(packing.token_pieces(docs, WORDS))
    ids_of = token_ids()
    want = sorted(itertools.chain.from_iterable(ids_of(r.text) for r in docs.collect()))
    rows = packing.sequences(found.placed).collect()
    assert sorted(itertools.chain.from_iterable(np.frombuffer(r.ids, "<u4").tolist() for r in rows)) == want
    assert all(len(r.ids) == 4 * r.length <= 4 * 4096 for r in rows) and len(rows) == found.sequences
