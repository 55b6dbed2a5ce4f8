"""Queries over the given pages against their DuckDB twins, on odd pages."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sitewright.operators.article_features import article_features
from sitewright.operators.page_features import page_features
from sitewright.operators.site import site_facts

SCHEMA = "page_id long, url string, html string"
CUT = ("&quot", "&quo", "&lt", "&gt", "&nbsp", "&amp", "&am", "&quot;", "&quot;&quot", "&lt;&gt", "&quots")


def page(title: str, text: str = "some words of a text that is long enough to be the content of its page") -> str:
    return (f"<!DOCTYPE html><html><head><title>{title}</title></head><body><nav><ul><li><a href=\"/q&lt\">Go &quot</a></li></ul></nav>"
            f"<article><h1>{title}</h1><p>{title} {text}</p></article></body></html>")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, f"https://s{i % 3}.example.com/en/{i}", page(f"Token {i} of {i % 3} = {cut}")) for i, cut in enumerate(CUT * 3)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


def differing(spark, path: str, name: str) -> tuple[list, list]:
    """Rows that only the query or only its twin has."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    df = entry.queries()[name](spark, path)
    mine = [repr(tuple(r)) for r in df.collect()]
    columns = ", ".join(f'"{c}"' for c in df.columns)
    theirs = [repr(r) for r in con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()]
    for r in list(mine):
        if r in theirs:
            mine.remove(r)
            theirs.remove(r)
    return mine, theirs


@pytest.mark.parametrize("name", [
    "competitor_report", "keyword_gaps", "own_and_competitor_keywords", "page_article_counts", "page_bigrams", "page_content", "page_headings",
    "page_links", "page_nav_items", "page_title_keywords", "page_title_lines", "page_titles", "page_tokens", "ranked_keyword_rows",
    "site_facts", "site_rivals", "title_groups"])
def test_cut_references_are_read_as_in_sql(spark, odd, name):
    assert differing(spark, odd, name) == ([], [])


def test_bare_references_are_characters_by_default(spark):
    df = spark.createDataFrame([(1, "https://a.com/x", page("a &quot"))], SCHEMA)
    assert [page_features(df, **o).first()["title"] for o in ({}, {"bare_references": False})] == ['a "', "a &quot"]
    article = df.select(F.col("page_id").alias("article_id"), "url", "html")
    assert [article_features(article, **o).first()["h1"] for o in ({}, {"bare_references": False})] == ['a "', "a &quot"]


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("repeated"))
    urls = ("https://a.example.com/1", "https://a.example.com/1", "https://a.example.com/2", "https://b.example.com/1/2/3/4/5",
            "https://b.example.com/1/2/3/4/5", "https://b.example.com/1")
    rows = [(i, u, page(f"Title {i}")) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", ["site_facts", "site_scores", "site_summary", "discovered_urls"])
def test_pages_of_one_url_count_as_in_sql(spark, repeated, name):
    assert differing(spark, repeated, name) == ([], [])


def test_the_operator_counts_different_urls(spark, repeated):
    features = page_features(spark.read.parquet(f"{repeated}/pages.parquet"))
    for given, counts in ((None, [(2, 0), (2, 1)]), (features.select("site", "url"), [(3, 0), (3, 2)])):
        facts = site_facts(features, discovered=given).orderBy("site").collect()
        assert [(r["n_discovered"], r["n_deep"]) for r in facts] == counts
