"""How the registered queries deal rows to tasks and which features they compute."""

import pytest
from pyspark.sql import functions as F

from sitewright.plans import registry
from sitewright.sources import pages as P


@pytest.fixture
def one_file(spark, tmp_path):
    """Tables of one file with one row group each, which no split divides."""
    for name, key, text in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):
        rows = spark.range(400).select(F.col("id").alias(key), F.concat(F.lit("https://a.example.com/"), "id").alias("url"),
                                       F.expr("repeat(sha2(string(id), 512), 4)").alias(text))
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_rows_of_a_single_row_group_are_dealt_to_parts_of_their_size(spark, one_file, monkeypatch):
    monkeypatch.setattr(P, "PART_BYTES", 20_000)
    for read, name, key in ((P.read_documents, "documents", "doc_id"), (P.read_pages, "pages", "page_id")):
        path = f"{one_file}/{name}.parquet"
        df = read(spark, path)
        assert P.parts_of(spark, path) > 2
        rows = df.groupBy(F.spark_partition_id()).count().collect()
        assert len(rows) == P.parts_of(spark, path)
        assert max(r["count"] for r in rows) < 400 / 2
        assert sorted(r[key] for r in df.select(key).collect()) == list(range(400))
        assert read(spark, path, 3).rdd.getNumPartitions() == 3


def test_queries_over_few_columns_do_not_store_all_features(spark, data_dir):
    registry._CACHE.clear()
    queries = registry.queries()
    for name in ("markup_broken_pages", "markup_crawl_queue", "discovered_with_sitemaps", "competitor_averages",
                 "token_cannibalization", "site_rivals", "keyword_gaps", "competitor_report"):
        queries[name](spark, data_dir)
    assert not {key[-1] for key in registry._CACHE} & {"stored_features", "stored_shop_features", "stored_articles"}


def test_stored_tables_leave_out_what_nothing_reads(spark, data_dir):
    queries = registry.queries()
    for name in ("markup_article_findings", "scan_rows", "markup_issue_evidence", "issue_examples"):
        queries[name](spark, data_dir)
    stored = {key[-1]: set(df.columns) for key, df in registry._CACHE.items()}
    for name in ("stored_features", "stored_shop_features"):
        assert not stored[name] & {"body_snippet", "has_table_of_contents", "external_links"}
    for name in ("stored_articles", "markup_articles"):
        assert not stored[name] & {"repeated_phrases", "raw_html"}
