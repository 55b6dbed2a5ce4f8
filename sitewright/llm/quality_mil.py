"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages with one label.  Every passage is encoded: counts of byte classes and of pairs of
them, repetition and word length go through a learned layer.  Gated attention weights the passages' encodings, and the
weighted encoding gives the score.  All weights are learned together from the document labels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE_WORDS = 64
#: The documented bounds of the fit: labelled documents, and passages of each, evenly spaced.
SAMPLE_DOCUMENTS = 6000
SAMPLE_PASSAGES = 12
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 30, 128, 0.01, 1e-4
GROUP_CHARS = 2_000_000
# Byte classes: white space, lower and upper case, digits, each ASCII sign, and bytes of other characters.
CLASS = np.full(256, 4, np.int64)
CLASS[[32, *range(9, 14)]] = 0
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 1, 2, 3
_SIGNS = [c for c in range(33, 127) if CLASS[c] == 4]
CLASS[_SIGNS] = np.arange(5, 5 + len(_SIGNS))
CLASSES = 5 + len(_SIGNS)
PAIRS = 128
FEATURES = CLASSES + PAIRS + 4


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, features) of every passage; a text without words has one passage without counts."""
    lists = [t.encode() for t in texts]
    split = [x.split() for x in lists]
    words = np.array([len(x) for x in split], np.int64)
    n_passages = np.maximum(1, -(-words // PASSAGE_WORDS))
    base = np.cumsum(n_passages) - n_passages
    total = int(n_passages.sum())
    out = np.zeros((total, FEATURES), np.float32)
    data = np.frombuffer(b"\n".join([*lists, b""]), np.uint8)
    sizes = np.array([len(x) + 1 for x in lists], np.int64)
    kind = CLASS[data]
    starts = (kind != 0) & (np.concatenate([[0], kind[:-1]]) == 0)
    word = np.cumsum(starts) - 1  # of all texts; white space belongs to the word before
    doc = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(words) - words
    passage = base[doc] + np.clip(word - first[doc], 0, None) // PASSAGE_WORDS
    passage = np.minimum(passage, (base + n_passages - 1)[doc])
    length = np.bincount(passage, minlength=total).astype(np.float32)
    share = np.maximum(length, 1)[:, None]
    out[:, :CLASSES] = np.bincount(passage * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES) / share
    pair = (kind[:-1] * 37 + kind[1:]) % PAIRS
    out[:, CLASSES:CLASSES + PAIRS] = np.bincount(passage[1:] * PAIRS + pair, minlength=total * PAIRS).reshape(total, PAIRS) / share
    out[:, :CLASSES + PAIRS] = np.sqrt(out[:, :CLASSES + PAIRS])
    n = int(words.sum())
    if n:
        h = np.fromiter((zlib.crc32(w) for x in split for w in x), np.int64, n)
        of = np.repeat(base, words) + (np.arange(n) - np.repeat(first, words)) // PASSAGE_WORDS
        in_passage = np.maximum(np.bincount(of, minlength=total), 1)
        key = np.sort(of * (1 << 32) + h)
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        again = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        out[:, -4] = np.bincount((key >> 32)[fresh], minlength=total) / in_passage
        out[:, -3] = np.bincount(of[1:][again], minlength=total) / in_passage
        out[:, -2] = length / in_passage / 10
        out[:, -1] = np.log1p(np.bincount(of, minlength=total)) / 5
    return np.repeat(np.arange(len(texts)), n_passages), out


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Gated-attention weights from bags of passage features and 0/1 labels, by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    model = {"mean": every.mean(0), "scale": every.std(0) + 0.05}
    width = max(map(len, bags))
    x = np.zeros((len(bags), width, FEATURES), np.float32)
    mask = np.zeros((len(bags), width), bool)
    for i, bag in enumerate(bags):
        x[i, :len(bag)] = (bag - model["mean"]) / model["scale"]
        mask[i, :len(bag)] = True
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"W": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE),
         "a": init(GATE), "c": init(HIDDEN), "c0": np.array([np.log((labels.mean() + 0.01) / (1.01 - labels.mean()))], np.float32)}
    m, v, step = {k: 0 * p for k, p in w.items()}, {k: 0 * p for k, p in w.items()}, 0
    for epoch in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // BATCH)):
            xb, mb, y = x[part], mask[part], labels[part]
            h = np.tanh(xb @ w["W"] + w["b"])
            t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
            e = np.where(mb, (t * g) @ w["a"], -np.inf)
            a = np.exp(e - e.max(1, keepdims=True))
            a /= a.sum(1, keepdims=True)
            z = np.einsum("bp,bph->bh", a, h)
            dy = ((1 / (1 + np.exp(-(z @ w["c"] + w["c0"])))) - y) / len(part)
            dz = dy[:, None] * w["c"]
            da = np.einsum("bh,bph->bp", dz, h)
            de = a * (da - (a * da).sum(1, keepdims=True))
            dtg = de[..., None] * w["a"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            dh = (a[..., None] * dz[:, None, :] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
            flat = lambda q: q.reshape(-1, q.shape[-1])
            grad = {"W": flat(xb).T @ flat(dh), "b": flat(dh).sum(0), "V": flat(h).T @ flat(dt), "U": flat(h).T @ flat(dg),
                    "a": np.einsum("bp,bpk->k", de, t * g), "c": z.T @ dy, "c0": np.array([dy.sum()])}
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k in w:
                d = grad[k] + DECAY * w[k] * (k != "c0")
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model | w


def predict(model: dict[str, np.ndarray], owner: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of the owners 0, 1, ... of passages in their order; each owner has one passage at least."""
    h = np.tanh(((x - model["mean"]) / model["scale"]) @ model["W"] + model["b"])
    e = (np.tanh(h @ model["V"]) / (1 + np.exp(-(h @ model["U"])))) @ model["a"]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    a = np.exp(e - np.maximum.reduceat(e, first)[owner])
    z = np.add.reduceat(a[:, None] * h, first) / np.add.reduceat(a, first)[:, None]
    return 1 / (1 + np.exp(-(z @ model["c"] + model["c0"])))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        keys, texts, chars = [], [], 0
        for i, value in enumerate(batch.column(batch.num_columns - 1)):
            texts.append(value.as_py() or "")
            keys.append(i)
            chars += len(texts[-1])
            if chars >= GROUP_CHARS:
                yield batch.slice(keys[0], len(keys)), texts
                keys, texts, chars = [], [], 0
        if keys:
            yield batch.slice(keys[0], len(keys)), texts


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> dict[str, np.ndarray] | None:
    """The model, from the SAMPLE_DOCUMENTS labelled documents with the smallest hashes of their ids; None without any.

    labels: rows to learn from.  Null labels are left out; of several labels of an id the least counts.
    """
    picked = (labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
              .select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_label"), F.xxhash64(key).alias("_hash"))
              .orderBy("_hash", "_key", "_label").limit(SAMPLE_DOCUMENTS).groupBy("_key").agg(F.min("_label").alias("_label")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _grouped(batches):
            owner, x = passages(texts)
            out = []
            for i in range(len(texts)):
                own = np.flatnonzero(owner == i)
                some = own[np.unique(np.linspace(0, len(own) - 1, min(len(own), SAMPLE_PASSAGES)).astype(int))]
                out.append(x[some].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(out, pa.binary())], names=["k", "label", "x"])

    # the sample is at most SAMPLE_DOCUMENTS ids, so it may be broadcast
    sample = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(picked), "_key")
    rows = sample.select(F.col("_key").cast("string"), "_label", "_text").mapInArrow(features, "k string, label double, x binary").collect()
    rows.sort(key=lambda r: (r["k"], bytes(r["x"])))
    if not rows:
        return None
    return fit([np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES) for r in rows], np.array([r["label"] for r in rows], np.float32))


def score_quality(docs: DataFrame, model: dict[str, np.ndarray] | None, text: str = "text") -> DataFrame:
    """docs with quality_score (0 to 1, higher is better; replaced if there); without a model all scores are 0.5.

    All passages count.  Null and empty texts are scored as a passage without words.
    """
    work = docs.drop("quality_score")
    columns = [c for c in work.columns if c != text]
    schema = T.StructType([*(work.schema[c] for c in columns), work.schema[text], T.StructField("quality_score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _grouped(batches):
            found = predict(model, *passages(texts)) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.astype(float), pa.float64())], names=[*part.schema.names, "quality_score"])

    return work.select(*columns, text).mapInArrow(score, schema)
