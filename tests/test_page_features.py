import pytest
from pyspark.sql import functions as F

from sitewright.functions import urls as U
from sitewright.operators.page_features import page_features, page_links

RICH = """<!doctype html><html><head><title>Big &amp; <b>X</b> FAQ &#233;&#x1F600; &amp;lt;</title>
<meta content=" desc here " name='description'><meta name=robots content="noindex, NOFOLLOW">
<link href="https://www.a.com/x" rel="canonical"><link rel="alternate" hreflang="th" href="/th">
<link rel="alternate" href="/feed"><meta property="og:title" content="a > b">
<script type="application/ld+json">{"@type":["Organization","WebSite"],"@graph":[{"@type":"FAQPage"},
{"@graph":[{"@type":"Product"}]}]}</script><script type="application/ld+json">{bad</script>
<style>:root{--main-color: #336699; --bg-color:#fff} a{background:#000000;background-color: #abcdef}</style>
</head><body><header><nav><a href="/a">A</a><a href="b/../c d?x=1#f" rel="x nofollow">FAQ_X</a></nav></header>
<!-- <h1>not here</h1> --><h1>One <b>title</b>
 here</h1><h1>Two</h1><h3>Step</h3>
<div class="wrap content"><div>in<div>ner</div></div><p>one<p>two and more words that make the zone long enough to count</div> tail
<a class="btn-x" href="javascript:void(0)" title="a>b">js</a><a href="//sub.a.com/z">z</a>
<img src=x alt=""><img alt="k" src="y"><img src=z><ol><li>1<li>2<li>3</ol>
<span class="post-author"><b>Bob</b></span><a href='?q=1'>q</a><a href="mailto:x@y">m</a><a href="#t">t</a>
<a href="https://other.org/1" rel=nofollow>out</a></body></html>"""


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(
        [(1, "https://a.com/p/q", RICH), (2, "http://about.example/faq/", None),
         (3, "https://b.com/", "<p>short</p><p>text"), (4, "https://b.com/x", "")],
        "page_id long, url string, html string")
    return {r["page_id"]: r for r in page_features(df).collect()}


def test_head(rows):
    r = rows[1]
    assert r["title"] == "Big & <b>X</b> FAQ é😀 &lt;"
    assert r["meta_description"] == "desc here" and r["meta_description_length"] == 9
    assert r["is_noindex"] and r["is_nofollow"] and not r["viewport"]
    assert r["canonical"] == "https://www.a.com/x"
    assert not r["canonical_is_self"] and not r["canonical_mismatch"]
    assert [tuple(h) for h in r["hreflang"]] == [("th", "/th")]
    assert r["og_title"] == "a > b" and not r["has_og_image"]
    assert r["brand_colors"] == ["#336699", "#abcdef"]
    assert r["title_keywords"] == ["big", "bxb", "faq"]


def test_structured_data(rows):
    r = rows[1]
    assert [s["type"] for s in r["schemas"]] == ["Organization,WebSite", "FAQPage", "Product"]
    assert r["has_organization_schema"] and r["has_website_schema"] and r["has_product_schema"]
    assert r["has_faq_schema"] and not r["has_breadcrumb_schema"] and not r["has_article_schema"]


def test_body(rows):
    r = rows[1]
    assert r["h1"] == "One title here" and r["h1_count"] == 2 and r["has_multiple_h1"]
    assert r["h3s"] == ["Step"] and r["h2_count"] == 0 and not r["heading_hierarchy_ok"]
    assert r["body_snippet"] == (
        "inneronetwo and more words that make the zone long enough to count")
    assert r["word_count"] == 12 and r["paragraph_count"] == 2
    assert (r["image_count"], r["missing_alt_count"], r["images_with_alt"]) == (3, 2, 1)
    assert r["has_author"] and not r["has_date"] and r["has_faq"] and r["has_cta_button"]
    assert r["has_numbered_list"] and not r["has_table"]
    assert r["nav_items"] == ["A", "FAQ_X"] and r["broken_nav_items"] == ["FAQ_X"]


def test_links(rows):
    r = rows[1]
    assert [l["href"] for l in r["internal_links"]] == [
        "https://a.com/a", "https://a.com/p/c%20d?x=1#f", "https://sub.a.com/z",
        "https://a.com/p/q?q=1"]
    assert [(l["href"], l["nofollow"]) for l in r["external_links"]] == [
        ("javascript:void(0)", False), ("https://other.org/1", True)]
    assert r["external_nofollow_count"] == 1 and r["external_dofollow_count"] == 1


def test_failed_fetch_keeps_defaults(rows):
    for i in (2, 4):
        r = rows[i]
        assert r["page_type"] == "other" and r["canonical_is_self"] and not r["has_faq"]
        assert r["word_count"] == 0 and r["internal_links"] == [] and r["title"] is None
    assert rows[2]["status"] == 200 and rows[2]["fetch_ms"] == 0


def test_short_content_falls_back_to_body(rows):
    assert rows[3]["body_snippet"] == "shorttext" and rows[3]["page_type"] == "home"


def test_page_links_table(spark, rows):
    df = spark.createDataFrame([(1, "https://a.com/p/q", RICH)], "page_id long, url string, html string")
    got = page_links(page_features(df)).orderBy("pos").collect()
    assert [r["is_internal"] for r in got] == [True] * 4 + [False] * 2


def test_long_hostile_markup(spark):
    """Unclosed tags and thousands of quotes must neither overflow the stack nor run away."""
    html = "<p>" + "<a " + '"" ' * 50_000 + "<div " + "x='1' " * 50_000 + "=" * 50_000
    df = spark.createDataFrame([(1, "https://a.com/", html)], "page_id long, url string, html string")
    assert page_features(df).count() == 1


TYPES = [
    ("https://x.com", "home"), ("https://x.com/", "home"), ("https://x.com/product/1/", "product"),
    ("https://x.com/products/1", "product"), ("https://x.com/Item/1", "product"),
    ("https://x.com/collections/a/", "category"), ("https://x.com/หมวด/a", "category"),
    ("https://x.com/service/a", "service"), ("https://x.com/faqs", "faq"),
    ("https://x.com/help-me", "faq"), ("https://x.com/about-us", "about"),
    ("https://x.com/contact", "contact"), ("https://x.com/podcast/1", "podcast"),
    ("https://x.com/blog/1", "blog"), ("https://x.com/blog", "other"),
    ("https://x.com/privacy", "policy"), ("https://x.com/zzz", "other"),
    ("https://about.example/", "home"),
]


def test_page_types(spark):
    df = spark.createDataFrame(TYPES, "url string, want string")
    got = df.select("url", "want", U.page_type(F.col("url")).alias("got")).collect()
    assert [(r["url"], r["got"]) for r in got] == [(r["url"], r["want"]) for r in got]
    strict = df.filter("url = 'https://about.example/'").select(
        U.page_type(F.col("url"), strict=True)).first()[0]
    assert strict == "about"


def test_url_parts(spark):
    df = spark.createDataFrame(
        [("HTTPS://WWW.Shop.com:8080/a/b/?q#f",), ("not a url",), ("https://u:p@h.io",)], "url string")
    c = F.col("url")
    got = [tuple(r) for r in df.select(
        U.host(c), U.site(c), U.path(c), U.depth(U.path(c)), U.scheme(c)).collect()]
    assert got[0] == ("www.shop.com", "shop.com", "/a/b/", 2, "https")
    assert got[1][0] is None and got[1][2] is None
    assert got[2][:3] == ("h.io", "h.io", "/")


def test_directory_pattern(spark):
    df = spark.createDataFrame([("/",), ("/a",), ("/a/b",), ("/a/b/c/d",)], "p string")
    assert [r[0] for r in df.select(U.directory_pattern(F.col("p"))).collect()] == [
        None, "/", "/a/...", "/a/b/..."]


def test_union_of_features_is_features_of_union(spark, data_dir):
    pages = spark.read.parquet(f"{data_dir}/pages.parquet")
    cols = ["page_id", "title", "word_count", "nav_items", "internal_link_count"]
    whole = page_features(pages).select(cols)
    parts = page_features(pages.filter("page_id % 2 = 0")).select(cols).union(
        page_features(pages.filter("page_id % 2 = 1")).select(cols))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))


def test_nothing_is_read_from_a_prefix(spark):
    menu = "".join(f"<a href='/n{i}'>Item {i}</a>" for i in range(39)) + "<a href='/z'>RAW_NAME</a>"
    html = (f"<html><body><nav>{menu}</nav><main><p>{'word ' * 3000} table of contents ภาษาไทย</p>"
            f"<a href='/long'>{'anchor ' * 30}</a></main></body></html>")
    f = page_features(spark.createDataFrame([(1, "https://a.com/x", html)], "page_id long, url string, html string"))
    r = f.first()
    assert r["has_thai_text"] and r["has_latin_text"] and r["has_table_of_contents"]
    assert len(r["nav_items"]) == 40 and r["broken_nav_items"] == ["RAW_NAME"]
    assert max(len(x["text"]) for x in r["internal_links"]) > 200
