"""Byte-level BPE over a corpus: every distinct pre-token is encoded once, wherever it stands.

1. Each task cuts its documents into pre-tokens and numbers the different ones of a block of documents; a document
   becomes a list of numbers in the order of its pre-tokens (the written table of blocks).
2. The blocks' different pre-tokens are dealt by their hash, so that all blocks' copies of one meet; each is encoded
   once and its ids go back to the blocks that asked.
3. A block joined with its ids puts the documents' ids together by position, and the token-byte table turns the ids
   back into bytes.

Lists of pre-tokens travel packed by (block, hash bucket), not as a row for each.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import written

#: A block ends with the document in which it reaches so many pieces between spaces.
BLOCK_PIECES = 3_000_000
# White space as the tokenizers' pattern means it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces that no pre-token crosses: the pattern's own rule for spaces, with runs of other characters left whole.
PIECES = f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Compression of what is written or sent in packed form.
LEVEL = 9
BLOCK = "block long, doc_ids array<long>, n_codes array<int>, codes binary, buckets binary, words array<struct<bucket:int,words:binary>>"


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: a line for each token with its bytes in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned numbers below 2^32, compressed: their high bytes first, then the low bytes of small and of large ones."""
    x = x.astype(np.uint32)
    low, high = (x & 255).astype(np.uint8), x >> 8
    planes = [(high >> shift).astype(np.uint8) for shift in (0, 8, 16)]
    return zstandard.compress(b"".join(part.tobytes() for part in (*planes, low[high == 0], low[high > 0])), LEVEL)


def unpack_numbers(x: bytes) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(x), np.uint8)
    n = len(data) // 4
    high = data[:n].astype(np.uint32) | data[n:2 * n].astype(np.uint32) << 8 | data[2 * n:3 * n].astype(np.uint32) << 16
    small, low = high == 0, np.empty(n, np.uint32)
    cut = 3 * n + int(small.sum())
    low[small], low[~small] = data[3 * n:cut], data[cut:]
    return high << 8 | low


def pack_words(words: list[bytes]) -> bytes:
    sizes = pack_numbers(np.array([len(w) for w in words], np.int64))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.compress(b"".join(words), LEVEL)


def unpack_words(x: bytes) -> list[bytes]:
    at = 4 + int.from_bytes(x[:4], "little")
    ends = np.cumsum(unpack_numbers(x[4:at])).tolist()
    data = zstandard.decompress(x[at:])
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


def _blocks(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    from pyspark import TaskContext

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, pre_tokens, first, made = re.compile(PIECES).findall, regex.compile(pattern).findall, TaskContext.get().partitionId() << 32, 0
        ids, lists, total, pieces = [], [], 0, {}

        def block() -> pa.RecordBatch:
            own = list(pieces)
            number: dict[str, int] = {}
            codes_of = [[number.setdefault(t, len(number)) for t in pre_tokens(p)] for p in own]
            size = np.array([len(c) for c in codes_of], np.int64)
            flat = np.array([c for codes in codes_of for c in codes], np.int32)
            start = np.cumsum(size) - size
            of_docs = [flat[_ragged(start[own], size[own])] for own in lists]  # by document: arrays of a whole block are kept few and narrow
            n_codes = np.array([len(x) for x in of_docs], np.int64)
            codes = np.concatenate([np.zeros(0, np.int32), *of_docs])
            of_docs.clear()
            uses = np.bincount(codes, minlength=len(number))
            order = np.argsort(-uses, kind="stable")  # frequent pre-tokens get small numbers, which pack better
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            names = list(number)
            words = [names[k].encode() for k in order.tolist()]
            bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
            by_bucket = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by_bucket])) + 1
            packed = [{"bucket": int(bucket[part[0]]), "words": pack_words([words[k] for k in part.tolist()])}
                      for part in np.split(by_bucket, cuts) if len(part)]
            return pa.RecordBatch.from_arrays([
                pa.array([first + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([n_codes.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([pack_numbers(rank[codes])], pa.binary()), pa.array([pack_numbers(bucket)], pa.binary()),
                pa.array([packed], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())])))],
                names=["block", "doc_ids", "n_codes", "codes", "buckets", "words"])

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = split(value.as_py() or "")
                ids.append(doc_id)
                lists.append(np.array([pieces.setdefault(p, len(pieces)) for p in found], np.int32))
                total += len(found) + 1
                if total >= BLOCK_PIECES:
                    yield block()
                    ids, lists, total, made = [], [], 0, made + 1
                    pieces.clear()
        if ids:
            yield block()

    return written(docs.mapInArrow(numbered, BLOCK))


def _encoded(blocks: DataFrame, ranks, pattern: str, buckets: int) -> DataFrame:
    """(block, bucket, n_ids, ids): the ids of each block's pre-tokens, in the order in which the block lists them."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        now, known = None, {}
        for batch in batches:
            sizes, ids = [], []
            for bucket, words in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                own = []
                for w in unpack_words(words.as_py()):
                    x = known.get(w)
                    if x is None:
                        x = known[w] = encoding.encode_ordinary(w.decode())
                    own.append(x)
                sizes.append(pack_numbers(np.array([len(x) for x in own], np.int64)))
                ids.append(pack_numbers(np.array([y for x in own for y in x], np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())],
                                             names=["block", "bucket", "n_ids", "ids"])

    asked = blocks.select("block", F.explode("words").alias("w")).select("block", "w.bucket", "w.words")
    return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(encode, "block long, bucket int, n_ids binary, ids binary")


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text",
                     buckets: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids are little-endian unsigned 32-bit integers, decoded the bytes they stand
    for.  One row for each row of docs, repeated or null ids included; a null text counts as empty and has no ids.

    Pre-tokens are dealt to `buckets` hash buckets (by default the session's shuffle partitions), which should grow
    with the vocabulary of the corpus; the ranks and the token-byte table are as large as the tokenizer's vocabulary.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(ranks)
    blocks = _blocks(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), pattern, buckets)

    def together(block: pa.Table, answers: pa.Table) -> pa.Table:
        token_bytes = [b""] * (max(shared.value.values(), default=-1) + 1)
        for token, rank in shared.value.items():
            token_bytes[rank] = token
        ids, counts, parts, texts = [], [], [], []
        answers = answers.sort_by("bucket")
        sizes_of = [unpack_numbers(x.as_py()) for x in answers.column("n_ids")]
        flat = np.concatenate([np.zeros(0, "<u4"), *(unpack_numbers(x.as_py()) for x in answers.column("ids"))])
        for r in range(block.num_rows):
            order = np.argsort(unpack_numbers(block.column("buckets")[r].as_py()), kind="stable")
            size = np.zeros(len(order), np.int64)
            size[order] = np.concatenate([np.zeros(0, np.int64), *sizes_of])
            start = np.zeros(len(order), np.int64)
            start[order] = np.cumsum(size[order]) - size[order]
            codes, at = unpack_numbers(block.column("codes")[r].as_py()), 0
            ids += block.column("doc_ids")[r].as_py()
            for n in block.column("n_codes")[r].as_py():
                own = codes[at:at + n]
                at += n
                found = flat[_ragged(start[own], size[own])]
                counts.append(len(found))
                parts.append(found.tobytes())
                texts.append(b"".join(map(token_bytes.__getitem__, found.tolist())))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                         "ids": pa.array(parts, pa.binary()), "decoded": pa.array(texts, pa.binary())})

    left = blocks.select("block", "doc_ids", "n_codes", "codes", "buckets").groupBy("block")
    right = _encoded(blocks, shared, pattern, buckets).groupBy("block")
    return left.cogroup(right).applyInArrow(together, "doc_id long, n_tokens long, ids binary, decoded binary")
