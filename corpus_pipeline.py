"""A corpus from raw documents to token ids, in five stages; each reads what the one before has kept.

A stage is a function of (spark, docs, sf_dir).  All but the last return the columns of documents.  Rows whose doc_id
is null are kept by the near-duplicate stage, which has no name for them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewright.llm.bpe import encode_documents, load_ranks
from sitewright.llm.common import written
from sitewright.llm.contamination import build_index, search
from sitewright.llm.language_id import identify_language, language_dictionaries, learns
from sitewright.llm.pii import find_pii, redact
from sitewright.llm.similar_texts import similar_texts

TOKENIZER = "byte_bpe_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without letters or with a narrow margin go."""
    boxed = docs.select(F.struct("*").alias("row"), "text")
    return identify_language(boxed, language_dictionaries(docs.filter(learns()))).filter("NOT lang_rejected").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id; of its repeated rows one stays.

    Two texts belong together when 0.8 or more of their shingles of five words are common to both.  The lattice of
    op5's SimHash operator links them first, checked exactly; an exact search finds the pairs that it can't reach.
    """
    found = similar_texts(docs, words=5, percent=80).filter("doc_id IS NOT NULL")
    chosen = found.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("_least")).select(
        F.col("_least.doc_id").alias("_id"), F.col("_least.text_hash").alias("_hash"))
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"))
    kept = (marked.join(chosen, ["_id", "_hash"], "left_semi")
            .withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_hash"))).filter("_n = 1"))
    return kept.select("row.*").unionByName(docs.filter(F.col("doc_id").isNull()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    keyed = docs.select(F.struct("*").alias("row"), "text", F.xxhash64("doc_id", "text").alias("_key"))
    found = search(build_index(keyed, key="_key"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), near=0)
    hit = found.filter("n_hit > 0").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(hit, "_key", "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    boxed = docs.select(F.struct("*").alias("row"), "text")
    clean = redact(find_pii(boxed)).withColumn("_chars", F.when(F.size("pii") > 0, F.length("text").cast("long")))
    new = {"text": F.col("text"), "n_chars": F.coalesce("_chars", "row.n_chars")} if "n_chars" in docs.columns else {"text": F.col("text")}
    return clean.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes that they decode to."""
    found = encode_documents(docs, load_ranks(public_tokenizers.path(TOKENIZER)), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL has neither the dictionaries of the first stage nor the tokenizer of the last; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
