"""Language by compression: the language whose dictionary makes a text smallest.

Each language's dictionary is raw content: pieces of labelled texts, taken by the order of their hash.  A text is cut
into frames of FRAME bytes, so that the dictionary and not the text's own past decides, and every frame is encoded
with every dictionary; the sizes of all frames are summed.  A small margin between the best two means rejection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The documented bound of the fit: so many labelled texts for each language, and so many characters of each.
SAMPLE_TEXTS = 256
SAMPLE_CHARS = 512
SALTS = 64
FRAME = 2048
LEVEL = 6
#: A text is rejected when the second best encoding is longer by less than this share.
MIN_MARGIN = 0.005
UNDETERMINED = "und"
#: Letters are compared without case; other ASCII characters count as spaces.
PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """What is compressed: lower case, letters only, one space after each word."""
    return b" ".join(text.lower().encode().translate(PLAIN).split()) + b" "


def language_dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Raw-content dictionaries, by language.  labelled: rows to learn from; null or blank texts and null languages
    are left out.  The rows with the smallest hashes are taken, so that the result doesn't depend on partitioning;
    the size of the result is bounded for each language, and the number of languages is that of the labels.  Languages with more
    labelled rows come first."""
    order = Window.partitionBy("_lang").orderBy("_hash", "_text")
    # a language's rows are first ranked in SALTS parts, so that the last ranking sees SALTS * SAMPLE_TEXTS rows at most
    part = Window.partitionBy("_lang", "_salt").orderBy("_hash", "_text")
    t = F.col(text)
    # a piece from a place that the hash names, not always the start
    place = (F.lit(1) + F.pmod(F.xxhash64(t, F.lit(7)), F.greatest(F.length(t) - SAMPLE_CHARS, F.lit(1)).cast("long"))).cast("int")
    picked = (labelled.filter(F.col(lang).isNotNull() & (F.trim(t) != ""))
              .select(F.col(lang).alias("_lang"), F.xxhash64(t).alias("_hash"), t.substr(place, F.lit(SAMPLE_CHARS)).alias("_text"))
              .withColumn("_salt", F.pmod(F.xxhash64("_hash"), F.lit(SALTS)))
              .withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= SAMPLE_TEXTS)
              .dropDuplicates(["_lang", "_hash"])  # copies are in one part, and one of them is enough
              .withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= SAMPLE_TEXTS)
              .groupBy("_lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "_text"))), lambda x: x["_text"]), "\n").alias("_all")))
    texts = {r["_lang"]: plain(r["_all"]) for r in picked.collect()}
    rows = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    return {k: texts[k] for k in sorted(texts, key=lambda k: (-rows[k], k))}


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text",
                      min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1) and lang_rejected; columns of these names are replaced.

    A null text, or one without any letter, or any text when nothing was learned, is `und`, has score 0 and is
    rejected.  Ties go to the language with more labelled rows.  Only the text decides.
    """
    work = docs.drop("lang_pred", "lang_score", "lang_rejected")
    at = work.columns.index(text)
    schema = T.StructType([*work.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())])
    names, raw = list(dictionaries), list(dictionaries.values())

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [zstandard.ZstdCompressor(level=LEVEL, dict_data=_ready(d), write_content_size=False, write_dict_id=False) for d in raw]
        letter = re.compile(r"[^\W\d_]")
        for batch in batches:
            preds, scores, rejected = [], [], []
            for value in batch.column(at).to_pylist():
                pred, score, reject = UNDETERMINED, 0.0, True
                if value and encoders and letter.search(value):
                    data = plain(value)
                    frames = [data[i:i + FRAME] for i in range(0, len(data), FRAME)]
                    sizes = [sum(len(e.compress(f)) for f in frames) for e in encoders]
                    best = min(range(len(sizes)), key=sizes.__getitem__)
                    second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
                    margin = (second - sizes[best]) / second
                    pred, score, reject = names[best], min(1.0, margin / (margin + 0.02)), margin < min_margin
                preds.append(pred)
                scores.append(score)
                rejected.append(reject)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*batch.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    return work.mapInArrow(predict, schema)


def _ready(content: bytes) -> zstandard.ZstdCompressionDict:
    ready = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    ready.precompute_compress(level=LEVEL)
    return ready


def learns(key: str = "doc_id", remainder: int = 2):
    """Whether a row may be learned from: crc32 of the id as text, mod 4, is not the held-out remainder."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4 != remainder
