import pytest
from pyspark.sql import functions as F

from sitewright.texts import sentences
from sitewright.operators import inputs as P
from sitewright.operators.article_competitors import competitor_averages, competitor_gaps
from sitewright.operators.article_features import article_features
from sitewright.operators.findings import article_failures, article_findings
from sitewright.operators.scoring import article_scores, article_verdicts, verdict

HTML = """<html><head><title> Japan visa guide </title><meta name="description" content="How to apply">
<meta name="robots" content="index"><link rel="canonical" href="https://t.com/visa"><meta property="og:title" content="T">
<script type="application/ld+json">{"@type":"FAQPage"}</script></head><body>
<h1>Japan  visa</h1><h2>Process steps</h2><h2>Common mistakes</h2><h2>FAQ</h2>
<p>What do I need for this visa? Why? This was true in 2019, 2020 and 2021. x2019 20199
<a href="/a">click here</a><a href="#b">Read more</a><a href="https://t.com/c">this link</a>
<a href="https://www.embassy.example/x" rel="nofollow">Embassy</a><a href="ftp://z">z</a></p>
<ul><li>a</li></ul><table><tr><td>1</td></tr></table><img src=a><img src=b alt=""><img src=c><img src=d>
<div class="author-box"><span>Ann</span> Lee</div><time datetime="2024-05-01">May</time>
Contact us on line or 081-234-5678, mail a.b@c.co.</body></html>"""


@pytest.fixture(scope="module")
def articles(spark):
    df = spark.createDataFrame(
        [(1, "https://t.com/visa", "https://t.com/visa", HTML),
         (2, None, None, "<body>" + "guaranteed: 100% success, guarantee your visa. " * 6
          + "go online now</body>"),
         (3, None, None, None)],
        "article_id long, url string, final_url string, html string")
    typed = df.withColumns({
        "detected_keyword": F.when(F.col("article_id") == 1, "japan visa"),
        "detected_article_type": F.when(F.col("article_id") == 1, "Visa").otherwise("General"),
        "detected_language": F.lit("English"), "main_url": F.col("url"),
    })
    return article_features(typed).cache()


def by_id(df):
    return {r["article_id"]: r for r in df.collect()}


def test_features(articles):
    r = by_id(articles)[1]
    assert r["title"] == "Japan visa guide" and r["h1"] == "Japan  visa"
    assert r["h2s"] == ["Process steps", "Common mistakes", "FAQ"]
    assert r["all_headings"] == ["Japan  visa", "Process steps", "Common mistakes", "FAQ"]
    assert r["schema_types"] == ["FAQPage"] and r["meta_description"] == "How to apply"
    assert (r["table_count"], r["list_count"], r["image_count"], r["missing_alt_count"]) == (1, 1, 4, 4)
    assert [l["href"] for l in r["internal_links"]] == ["/a", "#b", "https://t.com/c"]
    assert [l["href"] for l in r["external_links"]] == ["https://www.embassy.example/x"]
    assert r["nofollow_links"] == ["https://www.embassy.example/x"]
    assert r["weak_anchor_count"] == 3
    assert r["author_name"] == "Ann Lee" and r["date_text"] == "2024-05-01"
    assert r["has_faq"] and r["cta_phrases"] == ["contact us"]
    assert r["has_phone"] and r["has_email"] and r["has_line"]
    assert r["old_years"] == ["2019", "2020", "2021"]
    assert r["official_source_links"] == ["https://www.embassy.example/x"]
    assert len(r["questions_found"]) == 1 and r["questions_found"][0].endswith("need for this visa?")


def test_text_only(articles):
    r = by_id(articles)[2]
    assert r["overclaims"] == ["100%", "guaranteevisa", "100% success"]
    assert r["has_line"]  # "online" contains the word
    assert r["repeated_phrases"][:2] == ["guaranteed: 100%", "100% success,"]


def test_no_article(articles):
    r = by_id(articles)[3]
    assert not r["has_article"] and r["word_count"] is None and r["title"] is None


def test_scores(articles):
    got = {}
    for r in article_scores(articles).collect():
        got.setdefault(r["article_id"], {})[r["category"]] = (r["score"], r["status"])
        assert 0 <= r["score"] <= r["max_score"]
    one = got[1]
    assert one["crawl"] == (7, "excellent") and one["technical"] == (6, "excellent")
    assert one["intent"] == (6, "warning")  # keyword in title; not in the h1 as written; short
    assert one["competitors"] == (5, "warning") and one["trust"] == (12, "excellent")
    assert one["internal_links"] == (7, "excellent")
    assert one["snippet"] == (5, "excellent")  # title under 20 characters
    assert one["freshness"] == (3, "good") and one["conversion"] == (5, "excellent")
    assert got[3]["depth"][0] == 12 - 4 - 2 - 2  # no article: no table penalty
    totals = by_id(article_verdicts(articles))
    for i, cats in got.items():
        assert totals[i]["total"] == sum(s for s, _ in cats.values())
        assert totals[i]["max_total"] == 100


def test_verdict_bands(spark):
    df = spark.createDataFrame([(n,) for n in (97, 96, 93, 88, 80, 70, 60, 40, 39)], "n int")
    assert [r[0] for r in df.select(verdict(F.col("n"))).collect()] == [
        "Apex Weapon", "Unfair Advantage", "Unfair Advantage", "Page-One Contender",
        "Strong but Beatable", "Needs Strategic Upgrade", "Vulnerable", "Competitors Are Winning",
        "Rewrite / Merge / Noindex Candidate"]


def test_failures_and_findings(articles):
    kinds = {}
    for r in article_failures(articles).orderBy("article_id", "rank").collect():
        kinds.setdefault(r["article_id"], []).append(r["type"])
    assert kinds[1] == ["Thin Content"]
    assert kinds[2][:4] == ["Missing Title Tag", "Missing H1", "Compliance Risk: Overclaim Language",
                            "Thin Content"]
    assert "Thin Content" not in kinds[3]  # zero words do not count as thin
    f = by_id(article_findings(articles))
    assert f[1]["final_decision"] == "Rebuild From Scratch" and f[2]["worst_failure"] == "Missing Title Tag"
    # all but: Thai tone
    assert f[1]["checklist_percent"] == 90 and f[2]["checklist"] is None
    assert f[1]["can_extract"] == ["title=Japan visa guide", "faq", "tables=1", "h2s=3"]
    said = articles.limit(1).select(sentences(F.array(F.lit("words=12"), F.lit("no_title"), F.lit("own=x")))).first()[0]
    assert said == ["the text has 12 words", "the page has no title", "own=x"]
    assert f[1]["cannot_extract"] == [] and f[1]["conversion_issues"] == []


def test_competitors(spark, articles):
    targets = spark.createDataFrame(
        [(2, 1, 1), (2, 3, 2), (2, 99, 3), (2, 1, 4)],
        "article_id long, competitor_id long, position int")
    gaps = {r["position"]: r for r in competitor_gaps(targets, articles).collect()}
    assert set(gaps) == {1, 2, 3, 4}
    assert gaps[1]["has_faq"] and gaps[1]["has_table"] and gaps[1]["title_score"] == 32
    assert "has_faq" in gaps[1]["what_they_do_better"]
    assert gaps[3]["what_they_do_better"] == ["unfetched"] and not gaps[3]["fetched"]
    avg = competitor_averages(targets, articles).first()
    words = by_id(articles)[1]["word_count"]
    assert avg["n_competitors"] == 4 and abs(avg["competitor_mean_words"] - words / 2) < 1e-9
    joined = articles.join(competitor_averages(targets, articles), "article_id", "left")
    kinds = [r["type"] for r in article_failures(joined).filter("article_id = 2").collect()]
    assert "Competitor FAQ Gap" in kinds


INPUTS = [
    (1, "https://a.com/best-visa-guide.html", dict(
        main_url="https://a.com/best-visa-guide.html", confidence=70, detected_article_type="Visa",
        detected_language="English", website_base_url="https://a.com")),
    (2, "keyword: my topic\nsee https://a.com/x, https://b.com/sitemap.xml. https://c.com/y)", dict(
        main_url="https://a.com/x", sitemap_url="https://b.com/sitemap.xml",
        competitor_urls=["https://c.com/y"], detected_keyword="my topic", confidence=85)),
    (3, "คีย์เวิร์ด: วีซ่าญี่ปุ่น", dict(
        detected_keyword="วีซ่าญี่ปุ่น", detected_language="Thai", detected_article_type="Visa",
        confidence=10, has_no_input=True)),
    (4, "<div>hello hotel</div>", dict(
        raw_html="<div>hello hotel</div>", detected_article_type="Travel", confidence=60)),
    (5, "word " * 40, dict(raw_article_text=("word " * 40).strip(), confidence=60)),
    (6, "", dict(confidence=10, has_no_input=True, detected_language="Unknown")),
    (7, "<divider> x", dict(raw_html=None)),
]


def test_parse_inputs(spark):
    df = spark.createDataFrame([(i, t) for i, t, _ in INPUTS], "id int, raw_input string")
    got = {r["id"]: r.asDict() for r in P.parse_inputs(df).collect()}
    for i, _, want in INPUTS:
        for k, v in want.items():
            assert got[i][k] == v, (i, k)


def test_input_predicates(spark):
    df = spark.createDataFrame(
        [("a.com",), ("two words",), ("x\ny",), ("z" * 201,), ("How to do KEYWORD STUFFING",),
         ("fake traffic",), ("honest",)], "t string")
    got = [tuple(r) for r in df.select(P.is_site_input(F.col("t")), P.is_safe_input(F.col("t"))).collect()]
    assert got == [(True, True), (False, True), (False, True), (False, True), (False, False),
                   (False, False), (True, True)]


def test_keyword_inference_and_type_upgrade(spark):
    df = spark.createDataFrame(
        [("https://a.com/my-best_page.php", "H", "T", "General", "a HOTEL"),
         (None, None, "Head part | Brand", "General", "schengen"),
         (None, "H" * 90, None, "Affiliate", "visa")],
        "u string, h1 string, title string, kind string, body string")
    c = F.col
    got = [tuple(r) for r in df.select(
        P.inferred_keyword(c("u"), c("h1"), c("title")), P.upgraded_type(c("kind"), P.body_article_type(F.lower("body")))).collect()]
    assert got == [("my best_page", "Travel"), ("Head part", "Visa"), (None, "Affiliate")]


def test_nothing_of_an_article_is_read_from_a_prefix(spark):
    asked = " ".join(f"What is question number {i} about?" for i in range(12))
    text = f"{'plain words. ' * 1500} {asked} since 2015 {' '.join(f'pair{i} pair{i}x ' * 5 for i in range(12))} a hotel"
    rows = article_features(spark.createDataFrame(
        [(1, None, f"<html><body><p>{text}</p></body></html>")], "article_id long, url string, html string"))
    r = rows.first()
    assert "2015" in r["old_years"] and len(r["questions_found"]) == 12
    assert r["body_article_type"] == "Travel" and len(r["repeated_phrases"]) > 12
