"""The training-data operators against SQL, brute force, exact round trips and held-out labels."""

import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from sitewright.llm import automata, bpe, common, components, contamination, iblt, language_id, pii, quality_mil, queries, resharding, similar_texts, simhash, sparse_suffixes, sql

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "x y z"), (None, None), (4, "word " * 30000), (5, "é😀 tä 中文 \x00  x"), (6, "one two three " * 40), (7, "one two three " * 40)]


def table(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string")


def clashing(spark):
    """Rows with nulls, empty and long texts, repeats, and columns named as the operators name theirs."""
    extra = ["pii", "lang_pred", "quality_score", "shard", "slot", "moved", "fp", "n_words", "kept", "spans"]
    return table(spark).withColumns({c: F.lit("own") for c in extra})


def documents(spark, folder):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(sql.all_sql()))
def test_same_as_sql(spark, name):
    got = queries.queries()[name](spark, SMALL)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.sql(sql.all_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([r[i] for i in order]) for r in want.fetchall())


def test_flow_moves_the_fewest_bytes():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, m = rng.integers(1, 7, 2)
        supply = rng.integers(0, 50, n).tolist()
        capacity = resharding.equal_capacities(sum(supply), int(m))
        flow = resharding.least_cost_flow(supply, capacity)
        assert flow.sum(axis=1).tolist() == supply and (flow.sum(axis=0) <= capacity).all()
        stay = sum(min(a, b) for a, b in zip(supply, capacity))
        assert sum(flow[i, i] for i in range(min(n, m))) == stay
    dear = np.array([[5.0, 1.0], [1.0, 5.0]])
    assert resharding.least_cost_flow([3, 3], [3, 3], dear).tolist() == [[0, 3], [3, 0]]
    with pytest.raises(ValueError):
        resharding.least_cost_flow([3], [2])


def test_resharding(spark, tmp_path):
    rows = queries.op1_flow_resharding(spark, LARGER).collect()
    sizes = np.bincount([r.shard for r in rows], [r.size for r in rows], 16)
    assert len(rows) == 1000 and sizes.max() - sizes.min() <= max(r.size for r in rows)
    for shard in range(16):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    sized = clashing(spark).withColumn("size", resharding.text_size(F.col("text"))).withColumn("old_shard", F.lit(2))
    placed = resharding.reshard(sized.drop("text"), 4)
    assert placed.count() == len(ODD) and placed.filter("shard != old_shard").count() == placed.filter("moved").count()
    assert resharding.reshard(sized.limit(0).select("doc_id", "size", "old_shard"), 4).count() == 0
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(10).cast("long").alias("size"), (F.col("id") % 5).cast("int").alias("old_shard"))
    placed = resharding.reshard(docs, 4).cache()
    touched = resharding.rewrite(docs, placed, str(tmp_path / "new"))
    back = spark.read.parquet(str(tmp_path / "new"))
    assert back.count() == placed.filter(F.col("shard").isin(touched)).count()


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, digits[::-1]))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits),
                    "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


HOSTILE = ["a@b.co_x@y.com", "x" * 50000 + "@", "1" * 50000, "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3.04", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (415) 555-0100. +49 30 1234567",
           "a.b@c" + ".d" * 5000 + " é😀 z@z.zz", "IBAN GB82 WEST 1234 5698 7654 32, GB83 WEST 1234 5698 7654 32", "..@..", "@" * 1000]


def test_personal_data(spark):
    rows = documents(spark, LARGER) + list(enumerate(HOSTILE, 10_000))
    found = {r.doc_id: r.pii for r in pii.find_pii(table(spark, rows)).collect()}
    for i, text in rows:
        assert [(s.kind, s.start, s.end) for s in found[i] if s.kind != "iban"] == base_spans(text)
        assert all(0 <= s.score <= 1 for s in found[i])
    assert [text for i, text in rows if any(s.kind == "iban" for s in found[i])] == [HOSTILE[7]]
    clean = {r.doc_id: r.text for r in pii.redact(pii.find_pii(table(spark, rows))).collect()}
    for i, text in rows:
        want, at = "", 0
        for s in sorted(found[i], key=lambda s: s.start):
            want += (text[at:s.start] + f"<{s.kind}>") if s.start >= at else ""
            at = max(at, s.end)
        assert clean[i] == want + text[at:]
    assert pii.redact(pii.find_pii(clashing(spark))).filter("text is null").count() == 2


def test_languages(spark):
    held = queries.op3_zstd_language(spark, LARGER).join(spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    odd = language_id.identify_language(clashing(spark).union(clashing(spark).limit(1).withColumn("text", F.lit("12 !"))), {"en": b"one two three ", "xx": b"zzz "})
    rows = odd.collect()
    assert all(r.lang_pred == "und" and r.lang_rejected and r.lang_score == 0 for r in rows if not r.text or not re.search(r"[^\W\d_]", r.text))
    assert all(0 <= r.lang_score <= 1 for r in rows) and len(rows) == len(ODD) + 1
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    copies = spark.createDataFrame([("en", name(i % 400)) for i in range(8000)], "lang string, text string")
    learned = language_id.language_dictionaries(copies.repartition(5))["en"].split()
    assert len(learned) == len(set(learned)) == language_id.SAMPLE_TEXTS  # copies of a text count once
    assert language_id.identify_language(table(spark), {}).filter("lang_pred = 'und'").count() == len(ODD)


def test_contamination_blocks_and_proximity(spark, monkeypatch):
    index = contamination.build_index(clashing(spark))
    assert index.count() >= 1 and contamination.build_index(table(spark).limit(0)).count() == 0
    items = spark.createDataFrame([(1, "one two three"), (2, "three one"), (3, None), (None, "a"), (4, "three two one"), (5, "ä")], "item_id long, text string")
    one = {(r.segment, r.doc): (r.n_hit, r.items, r.near_items) for r in contamination.search(index, items).collect()}
    assert sorted(len(x[1]) for x in one.values()) == [0] * 8 + [2, 2] and all(x[2] in ([], [1, 2, 4]) for x in one.values())
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 8)
    assert {(r.segment, r.doc): (r.n_hit, r.items, r.near_items) for r in contamination.search(index, items).collect()} == one


def near_groups(prints):
    names = sorted(set(prints.values()))
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in names:
        for b in names:
            if a < b and bin(a ^ b).count("1") <= 2:
                root[find(b)] = find(a)
    least = {}
    for i, x in prints.items():
        least[find(x)] = min(least.get(find(x), i), i)
    return {i: least[find(x)] for i, x in prints.items()}


def test_simhash(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 500, 600)]
    near = []
    for i in range(150):
        copy = list(base)
        copy[int(rng.integers(600))] = f"new{i}"
        near.append((10_000 + i, " ".join(copy)))
    rows = documents(spark, SMALL) + near
    prints = {}
    for i, text in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))
    want = near_groups(prints)
    for bits in (2, 4):
        got = simhash.near_duplicates(table(spark, rows), bits=bits).collect()
        assert {r.doc_id: r.fp % 2**64 for r in got} == prints and {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(set(prints.values()))  # some links are not between equal prints
    odd = simhash.near_duplicates(clashing(spark)).collect()
    assert len(odd) == len(ODD) and {r.component_id for r in odd if r.fp == 0} == {1}
    assert simhash.near_duplicates(table(spark).limit(0)).count() == 0


def test_tokens(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_PIECES", 20_000)
    rows = documents(spark, SMALL) + ODD + [(9, "a  b\n\n c\t\td 　x y\x85z \x1c\x1d q  "), (9, "it's we'll'S 12३ <|endoftext|>"), (9, " " * 3000 + "b")]
    got = sorted((r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode_documents(table(spark, rows), RANKS, P.PATTERN).collect())
    want = []
    for _, text in rows:
        ids = ENCODING.encode_ordinary(text or "")
        want.append((len(ids), np.array(ids, "<u4").tobytes(), (text or "").encode()))
    assert got == sorted(want)
    assert bpe.encode_documents(table(spark).limit(0), RANKS, P.PATTERN).count() == 0


def test_packed_numbers():
    rng = np.random.default_rng(5)
    for high in (1, 255, 256, 2**16, 2**32):
        for n in (0, 1, 1000):
            x = rng.integers(0, high, n)
            assert (bpe.unpack_numbers(bpe.pack_numbers(x)) == x).all()


def test_fingerprints(spark):
    rows = sorted(documents(spark, SMALL), reverse=True)
    got = {r.doc_id: r for r in queries.op8_iblt_fingerprint(spark, SMALL).collect()}
    prints = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, *others = (set(iblt.paragraph_digests([t])[1].tolist()) for t in (text, edited, after))
        for value, other in zip((got[i].near_edited, got[i].near_next), others):
            assert value == pytest.approx(len(own & other) / len(own | other) if own | other else 1)
        assert prints.setdefault(text, got[i].fingerprint) == got[i].fingerprint
    # both values follow from the fingerprints alone
    ids = [i for i, _ in rows]
    own, new = (iblt.Prints.read([getattr(got[i], c) for i in ids]) for c in ("fingerprint", "edited_fingerprint"))
    after = iblt.Prints.read([got[ids[(k + 1) % len(ids)]].fingerprint for k in range(len(ids))])
    assert iblt.likeness(own, new).tolist() == [got[i].near_edited for i in ids]
    assert iblt.likeness(own, after).tolist() == [got[i].near_next for i in ids]
    for k in range(0, len(ids), 10):
        assert sorted(own.digests(np.array([k]))[1].tolist()) == sorted(iblt.paragraph_digests([rows[k][1]])[1].tolist())
    assert iblt.paragraph_digests(["plumless"])[1].tolist() != iblt.paragraph_digests(["buckeroo"])[1].tolist()
    assert iblt.fingerprint_edits(clashing(spark)).count() == len(ODD)
    assert iblt.fingerprint_edits(table(spark).limit(0)).count() == 0
    assert [r.near_next for r in iblt.fingerprint_edits(table(spark, [(1, "a b c")])).collect()] == [1.0]


def test_repeats_odd_rows(spark):
    rows = [*ODD, (8, "p " + "one two three " * 40), (9, " ".join(f"u{i}" for i in range(60)) + " " + "one two three " * 20)]
    ids = [(i, t.split() if t else []) for i, t in rows]
    for n, run in ((13, automata.remove_repeats), (50, sparse_suffixes.repeated_passages), (3, automata.remove_repeats)):
        got = run(table(spark, rows), n).collect()
        starts = {}
        for i, w in ids:
            for s in range(len(w) - n + 1 if i is not None else 0):
                starts.setdefault(tuple(w[s:s + n]), set()).add(i)
        want = []
        for i, w in ids:
            hit = set()
            for s in range(len(w) - n + 1 if i is not None else 0):
                there = starts[tuple(w[s:s + n])]
                if min(there) < i if run is automata.remove_repeats else len(there) > 1:
                    hit |= set(range(s, s + n))
            want.append((str(i), len(w), len(hit)))
        assert sorted((str(r[0]), r[1], r[2]) for r in got) == sorted(want)
        assert run(clashing(spark)).count() == len(ODD) and run(table(spark).limit(0)).count() == 0


def test_automaton_matching_statistics():
    rng = np.random.default_rng(2)
    for _ in range(30):
        texts = [[b"%d" % x for x in rng.integers(0, 3, rng.integers(1, 25))] for _ in range(4)]
        auto = automata.SuffixAutomaton()
        for k, t in enumerate(texts):
            auto.add(t, k)
        auto.settle()
        probe = [b"%d" % x for x in rng.integers(0, 3, 30)]
        for end, (length, state) in enumerate(auto.matches(probe), 1):
            holds = lambda x: [k for k, t in enumerate(texts) if any(t[i:i + len(x)] == x for i in range(len(t)))]  # noqa: B023, E731
            assert not length or holds(probe[end - length:end])
            assert length == end or not holds(probe[end - length - 1:end])
            for part in range(1, length + 1):
                assert auto.least_of_suffix(state, part) == holds(probe[end - part:end])[0]


def test_quality(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = queries.op10_attention_mil(spark, LARGER).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9 and np.mean([r.predicted == r.quality for r in rows]) > 0.9
    scored = quality_mil.score_quality(clashing(spark), None).collect()
    assert len(scored) == len(ODD) and {r.quality_score for r in scored} == {0.5}
    assert quality_mil.fit_quality(table(spark), labels.limit(0)) is None
    model = quality_mil.fit_quality(table(spark), spark.createDataFrame([(3, 1), (3, 0), (4, 1), (None, 1), (6, None)], "doc_id long, quality int"))
    assert all(0 <= r.quality_score <= 1 for r in quality_mil.score_quality(clashing(spark), model).collect())


def test_pipeline(spark):
    import corpus_pipeline

    got = sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect()))
    texts = dict(documents(spark, SMALL))
    rejected = {r.doc_id for r in queries.op3_zstd_language(spark, SMALL).filter("rejected").collect()}
    kept = {i: t for i, t in texts.items() if i not in rejected}
    groups = similar_groups(kept)
    hit = {r.doc_id for r in queries.op4_positional_index(spark, SMALL).filter("contaminated").collect()}
    want = []
    for i, text in kept.items():
        if groups[i] == i and i not in hit:
            clean, at = "", 0
            for kind, a, b in sorted(base_spans(text), key=lambda s: s[1:]):
                clean += (text[at:a] + f"<{kind}>") if a >= at else ""
                at = max(at, b)
            clean += text[at:]
            ids = ENCODING.encode_ordinary(clean)
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(clean.encode()).hexdigest()))
    assert got == sorted(want) and 0 < len(got) < len(texts)


def similar_groups(texts, percent=80):
    """The least id that chains of pairs with so similar sets of five words reach, by brute force."""
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in texts.items())}
    group = {i: i for i in texts}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i]) * 100 >= percent * len(sets[j]) and len(sets[j]) * 100 >= percent * len(sets[i]):
                if len(sets[i] & sets[j]) * 100 >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                    old, new = max(group[i], group[j]), min(group[i], group[j])
                    group = {k: new if g == old else g for k, g in group.items()}
    return group


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, extra columns named as the operators name theirs, empty tables."""
    import corpus_pipeline

    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    long_text = "a very long text of words " * 40_000
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the same text here", "en", "s", 18), (2, "the same text here", "en", "s", 18),
            (3, "the same text here", None, "s", 18), (4, long_text, "en", "s", len(long_text)), (5, long_text + "end", "en", "s", len(long_text) + 3)]
    odd = spark.createDataFrame(rows, schema).withColumns({n: F.lit("own") for n in ("row", "pii", "label", "seq", "_key", "key", "n")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SMALL).columns == odd.columns
        assert stage(spark, odd.limit(0), SMALL).count() == 0
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, odd, SMALL).collect()) == ["1", "2", "4", "None"]
    found = corpus_pipeline.tokens(spark, odd, SMALL).collect()
    want = [(r[0], hashlib.sha256(np.array(ENCODING.encode_ordinary(r[1] or ""), "<u4").tobytes()).hexdigest()) for r in rows]
    assert sorted(str((r.doc_id, r.ids_sha256)) for r in found) == sorted(map(str, want))
    assert corpus_pipeline.tokens(spark, odd.limit(0), SMALL).count() == 0


def test_parity_bits_never_exceed_the_difference():
    rng = np.random.default_rng(8)
    for n in (0, 1, 5, 200, 5000):
        a = np.unique(rng.integers(-2**63, 2**63 - 1, n))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(-2**63, 2**63 - 1, n // 5)]))
        bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in similar_texts.parity_bits(a) ^ similar_texts.parity_bits(b))
        assert bits <= len(np.setxor1d(a, b)) and (n < 5 or bits > 0)


def test_near_dedup_repeated_id_of_two_groups(spark):
    import corpus_pipeline

    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = table(spark, [(1, one), (2, one), (1, other), (3, other), (4, one)])
    kept = corpus_pipeline.near_dedup(spark, docs, SMALL).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, one), (1, other)]


def test_near_dedup_finds_all_similar_texts(spark):
    """Against all pairs by brute force, with planted copies of several lengths around the bound and a hub of near copies."""
    import corpus_pipeline

    rng = np.random.default_rng(3)
    texts = [t for _, t in documents(spark, SMALL)][:60] + ["", "a b", "A  b", "a b c"]
    for n in (5, 6, 30, 200):
        base = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        texts.append(" ".join(base))
        for cut in range(1, 1 + n // 8):
            own = list(base)
            for at in rng.choice(n, max(1, cut // 5), replace=False):
                own[at] = f"x{rng.integers(10**6)}"
            texts.append(" ".join(own[cut:]))
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    found = {r.doc_id: r.label for r in similar_texts.similar_texts(table(spark, list(enumerate(texts)))).collect()}
    assert {(i, j) for i in found for j in found if found[i] == found[j]} == {(i, j) for i in found for j in found if group[i] == group[j]}
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, table(spark, list(enumerate(texts))), SMALL).collect()}
    assert kept == set(first.values()) and len(kept) < len(texts) - 10


def test_near_links_in_halves(spark):
    rng = np.random.default_rng(5)
    prints = [int(x) for x in rng.integers(-2**63, 2**63 - 1, 150)] + [0, -1, -2**63]
    for x in prints[:100]:
        for _ in range(2):
            flips = rng.choice(64, int(rng.integers(1, 9)), replace=False)
            y = (x ^ sum(1 << int(b) for b in flips)) % 2**64
            prints.append(y - (y >> 63 << 64))
    prints = sorted(set(prints))
    group = {x: x for x in prints}
    for x in prints:
        for y in prints:
            apart = (x ^ y) % 2**64
            if x < y and min((apart & 0xFFFFFFFF).bit_count(), (apart >> 32).bit_count()) <= 2 and group[x] != group[y]:
                old, new = max(group[x], group[y]), min(group[x], group[y])
                group = {k: new if g == old else g for k, g in group.items()}
    for bits in (2, 4):
        links = simhash.near_links(spark.createDataFrame([(x,) for x in prints], "fp long"), bits, parts=2)
        assert {(r.id, r.label) for r in simhash.connected(links).collect()} == {(x, g) for x, g in group.items() if list(group.values()).count(g) > 1}


def test_near_dedup_takes_the_lattice_first(spark, monkeypatch):
    """With the search by shingles off, near fingerprints are still linked, and checked: equal ones of different sets stay apart."""
    import corpus_pipeline

    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 600)]
    copies = [" ".join([*base[:at], "new", *base[at + 1:]]) for at in range(50, 600, 50)]
    often = " ".join(f"r{i}" for i in range(11)) + " "  # an odd number, so no bit is a tie
    apart = [often * 300 + " ".join(f"{c}{i}" for i in range(40)) for c in "xy"]
    assert simhash.simhash(apart[0], 5) == simhash.simhash(apart[1], 5)
    texts = [" ".join(base), *copies, *apart, "another text that stands alone here"]
    monkeypatch.setattr(similar_texts, "STARS", -1)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, table(spark, list(enumerate(texts))), SMALL).collect()}
    assert kept >= {0, 12, 13, 14} and len(kept) < 4 + len(copies) / 2
    monkeypatch.undo()
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, table(spark, list(enumerate(texts))), SMALL).collect()}
    assert kept == {0, 12, 13, 14}


def test_near_dedup_work_follows_the_texts(spark, monkeypatch):
    """In a group of near copies, pairs and links of all turns after the lattice are fewer than texts; no turn takes up old links."""
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    texts = []
    for _ in range(400):
        own = list(base)
        for at in rng.choice(300, int(rng.integers(1, 7)), replace=False):
            own[at] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(own))
    pairs, links = [], []
    look, join = similar_texts._similar_pairs, similar_texts.connected
    monkeypatch.setattr(similar_texts, "_similar_pairs", lambda p, *rest: (pairs.append(p.count()), look(p, *rest))[1])
    monkeypatch.setattr(similar_texts, "connected", lambda edges: (links.append(edges.count()), join(edges))[1])
    found = similar_texts.similar_texts(table(spark, list(enumerate(texts)))).collect()
    assert len(found) == 400 and len({r.label for r in found}) == 1
    assert sum(pairs[1:]) < 400 and sum(links[1:]) < 400


def test_few_links_make_few_files_at_many_partitions(spark, monkeypatch):
    before, files, write = spark.conf.get("spark.sql.shuffle.partitions"), [], components.written
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    monkeypatch.setattr(components, "written", lambda *a: (out := write(*a), files.append(len(out.inputFiles())))[0])
    links = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 30], "u long, v long")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = {(r.id, r.label) for r in components.connected(links).collect()}
        monkeypatch.setattr(common, "PART_ROWS", 50)
        assert {(r.id, r.label) for r in components.connected(links).collect()} == found
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert found == {(i, (i - 1) // 30 * 30 + 1) for i in range(1, 301)}
    second = len(files) // 2
    assert max(files[1:second]) == 1 and max(files[second + 1:]) > 1  # each run's first table is the links themselves


def test_connected_over_odd_graphs(spark):
    rng = np.random.default_rng(6)
    ids = [int(x) for x in rng.permutation(300) * 7 - 1000]
    path = list(zip(ids, ids[1:], strict=False))
    star = [(10**6, 10**6 + i) for i in range(1, 200)]
    loose = [tuple(int(y) for y in rng.integers(2 * 10**6, 2 * 10**6 + 150, 2)) for _ in range(90)]
    odd = [(-2**63, 2**63 - 1), (2**63 - 1, -2**63), (5 * 10**6, 5 * 10**6), (0, 10**7), (0, 10**7)]
    edges = [*path, *[(v, u) for u, v in star], *loose, *odd]
    group = {x: x for e in edges for x in e}
    for u, v in edges:
        old, new = max(group[u], group[v]), min(group[u], group[v])
        group = {k: new if g == old else g for k, g in group.items()}
    found = simhash.connected(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r.id, r.label) for r in found} == set(group.items()) and len(found) == len(group)
    assert simhash.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_account_numbers_before_words(spark):
    number = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606"]
    cases = [(f"{before}{n}{after}", n) for n in number for before in ("", "the latest, our greatest order test sample: ", "border\n")
             for after in (" Please pay", " BIC COBADEFFXXX", " 12 May", " I pay", ".", " 2024", "")]
    found = {r.doc_id: r for r in pii.redact(pii.find_pii(table(spark, [(i, t) for i, (t, _) in enumerate(cases)])).withColumn("whole", F.col("text"))).collect()}
    for i, (text, n) in enumerate(cases):
        assert [text[s.start:s.end] for s in found[i].pii if s.kind == "iban"] == [n], text
        assert "<" in found[i].text and n[-4:] not in found[i].text
    wrong = ["DE88370400440532013000 Please", "DE893704004405320130001", "xDE89370400440532013000", "DE8937040044053201300"]
    assert not any(s.kind == "iban" for r in pii.find_pii(table(spark, list(enumerate(wrong)))).collect() for s in r.pii)
    scores = [r.pii[0].score for r in pii.find_pii(table(spark, [(0, "the latest border +49 30 1234567"), (1, "a test +49 30 1234567")])).orderBy("doc_id").collect()]
    assert scores == [0.7, 0.4]


def test_rewrite_null_and_repeated_ids(spark, tmp_path):
    rows = [(None if i % 4 == 0 else i % 7, f"text {i % 50} " * (i % 9), i % 3) for i in range(300)] + [(None, None, 0), (None, None, 0), (3, None, 1)]
    docs = (spark.createDataFrame(rows, "doc_id long, text string, old_shard int")
            .withColumn("size", resharding.text_size(F.col("text"))).withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")))))
    placed = resharding.reshard(docs.drop("text"), 5, order=("doc_id", "text_crc32")).cache()
    touched = resharding.rewrite(docs, placed, str(tmp_path / "new"))
    back = spark.read.parquet(str(tmp_path / "new")).collect()
    want = placed.filter(F.col("shard").isin(touched)).collect()
    place = lambda r: (r.shard, r.slot, r.doc_id, r.size, r.text_crc32, r.old_shard)
    assert sorted(map(str, map(place, back))) == sorted(map(str, map(place, want))) and len(set((r.shard, r.slot) for r in back)) == len(back)
    texts = sorted(str((r.doc_id, r.text, r.old_shard)) for r in back)
    assert texts == sorted(str(r) for r in rows if r[2] in touched) and len(texts) > 250


def test_contamination_items_without_id(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = table(spark, [(1, f"a b {passage} c"), (2, "nothing of it here")])
    for ids in ([None], [None, 7]):
        benchmark = spark.createDataFrame([(i, passage) for i in ids], "item_id long, text string")
        found = {r.doc_id: r for r in contamination.search(contamination.build_index(docs), benchmark).collect()}
        assert found[1].n_hit == 40 and found[1]["items"] == [i for i in ids if i] and found[2].n_hit == 0
