"""The registered queries of the operators: each applies one to its whole table and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 unequal old shards, the last of which holds over a quarter, become 16 of equal bytes."""
    from sitewright.llm.resharding import reshard, text_size

    h = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(32)).cast("int")
    sized = documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id", text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), F.least(h, F.lit(23)).alias("old_shard"))
    placed = reshard(sized, 16, order=("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitewright.llm.pii import BASE_KINDS, find_pii

    found = find_pii(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "pii")
    joined = lambda spans: F.concat_ws(",", F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
        F.concat_ws(",", F.transform("pii", lambda s: s["score"].cast("string"))).alias("scores"))


def op3_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitewright.llm.language_id import identify_language, language_dictionaries, learns

    learned = language_dictionaries(documents(spark, sf_dir, "doc_id", "text", "lang").filter(learns()))
    found = identify_language(documents(spark, sf_dir, "doc_id", "text"), learned)
    return found.select("doc_id", (~learns()).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
                        F.col("lang_rejected").alias("rejected"))


def op4_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitewright.llm.contamination import build_index, search

    found = search(build_index(documents(spark, sf_dir, "doc_id", "text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitewright.llm.simhash import near_duplicates

    found = near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    from sitewright.llm.bpe import encode_documents, load_ranks

    found = encode_documents(documents(spark, sf_dir, "doc_id", "text"), load_ranks(public_tokenizers.path(tokenizer)), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitewright.llm.iblt import fingerprint_edits

    found = fingerprint_edits(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitewright.llm.quality_mil import fit_quality, score_quality

    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(~held_out)
    docs = documents(spark, sf_dir, "doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"),
                         F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in passages of 50 words or more that another document has too."""
    from sitewright.llm.sparse_suffixes import repeated_passages

    found = repeated_passages(documents(spark, sf_dir, "doc_id", "text"))
    joined = F.concat_ws(",", F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.concat_ws(
        ":", F.get("spans", i).cast("string"), F.get("spans", i + 1).cast("string"))))
    return found.select("doc_id", "n_words", "n_repeated", F.when(F.size("spans") > 0, joined).otherwise(F.lit("")).alias("spans"))


def op9_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitewright.llm.automata import remove_repeats

    found = remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults by rule: lost, emptied, cut off, repeated rows and wrong roles; nulls count as one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = name("text")
    return rows.withColumn("_code", code).filter("_code <> 0").select(
        "conv_id", "turn", F.when(F.col("_code") == 4, "user").otherwise(name("role")).alias("role"),
        F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def op11_path_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitewright.llm.common import written
    from sitewright.llm.conversations import conversation_digests, conversation_key, repair_conversations, turn_gaps

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    original = rows.groupBy("conv_id").agg(F.lit(1).alias("_one")).select("conv_id", conversation_key(F.col("conv_id")).alias("conv"))
    faulty = damaged(rows)
    blocks = written(repair_conversations(faulty))
    counts = ("blank", "duplicate", "truncated", "illegal")
    counted = blocks.groupBy("conv").agg(*[F.sum(c).alias(c) for c in counts], F.min_by("cost", "block").alias("cost"))
    found = original.join(turn_gaps(faulty), "conv", "left").join(counted, "conv", "left").join(conversation_digests(blocks), "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select("conv_id", zero("gaps"), *map(zero, counts), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def op12_laesa_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitewright.llm.pivot_clusters import centroid_digest, pivot_clusters

    found = pivot_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    # one row for each of the 40 centroids
    own = {r.cluster: r.d for r in found.assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    named = spark.createDataFrame([(i, own[i], sum(own.values()), centroid_digest(found.centroids[i])) for i in sorted(own)],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_certified_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    from sitewright.llm.packing import pack, token_pieces

    pieces = token_pieces(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path(tokenizer), with_ids=False).drop("ids")
    found = pack(pieces)
    return found.placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                               F.lit(found.sequences).cast("long").alias("sequences"), F.lit(found.bound).cast("long").alias("bound"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_flow_resharding, op2_pii_spans, op3_zstd_language, op4_positional_index, op5_simhash_popcount,
             op6_sparse_suffixes, op7_byte_bpe, op8_iblt_fingerprint, op9_suffix_automata, op10_attention_mil, op11_path_ranking, op12_laesa_clusters, op13_certified_packing, pipeline)
    return {q.__name__: q for q in named}
