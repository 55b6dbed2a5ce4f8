import pytest
from pyspark.sql import functions as F

from sitewright.functions.ranking import collect_ranked, reuse, top_k
from sitewright.operators import issues as I
from sitewright.operators import keywords as K
from sitewright.operators import page_ranking as R
from sitewright.operators import site as S
from sitewright.operators.page_features import page_features
from sitewright.plans.site_audit import audit_overview, site_audit

SCHEMA = "page_id long, url string, html string, status int, fetch_ms long"
WORDS = " ".join(f"word{i}" for i in range(400))


def page(meta=True, h1="A good long heading", words=WORDS, title="Some title", extra=""):
    head = f"<title>{title}</title>" if title else ""
    head += '<meta name="description" content="d">' if meta else ""
    h = f"<h1>{h1}</h1>" if h1 else ""
    return f"<html><head>{head}</head><body><main>{h} <p>{words}</p>{extra}</main></body></html>"


def site_rows(host, pages):
    """pages: (path, html, status, fetch_ms)"""
    return [(f"https://{host}{p}", h, s, ms) for p, h, s, ms in pages]


@pytest.fixture(scope="module")
def thresholds(spark):
    rows = []
    # exactly 15 % without meta, and just above
    for host, n in (("meta15.com", 3), ("meta20.com", 4)):
        rows += site_rows(host, [(f"/x{i}", page(meta=i >= n, title=f"t{i}"), 200, 0) for i in range(20)])
    # 30 % and above without h1
    for host, n in (("h30.com", 3), ("h40.com", 4)):
        rows += site_rows(host, [(f"/x{i}", page(h1="" if i < n else "A good long heading"), 200, 0)
                                 for i in range(10)])
    # three and four broken pages; they count for all pages only
    for host, n in (("broken3.com", 3), ("broken4.com", 4)):
        rows += site_rows(host, [(f"/x{i}", page(), 404 if i < n else 200, 0) for i in range(8)])
    # 299 and 300 words (heading: five more)
    for host, n in (("thin.com", 294), ("thick.com", 295)):
        text = " ".join(["ab"] * n)
        rows += site_rows(host, [("/x", page(words=text, h1="aa bb cc dd eeee"[:14]), 200, 0)])
    # mean fetch time around the limits
    for host, ms in (("ms3000.com", 3000), ("ms3001.com", 3001), ("ms6000.com", 6000)):
        rows += site_rows(host, [("/x", page(), 200, ms)])
    # nothing was fetched
    rows += site_rows("empty.com", [("/x", None, 500, 10)])
    # status unknown counts for issues, not for scores
    rows += site_rows("null.com", [("/", page(meta=False), None, 0)])
    data = [(i, *r) for i, r in enumerate(rows)]
    return reuse(page_features(spark.createDataFrame(data, SCHEMA)), "thresholds")


@pytest.fixture(scope="module")
def issues(thresholds):
    got = {}
    for r in I.site_issues(S.site_facts(thresholds), thresholds).collect():
        got[(r["site"], r["issue_id"])] = r
    return got


def test_limits_are_strict(issues):
    assert ("meta15.com", "no_meta_description") not in issues
    assert issues[("meta20.com", "no_meta_description")]["affected_count"] == 4
    assert issues[("h30.com", "missing_h1")]["priority"] == "high"
    assert issues[("h40.com", "missing_h1")]["priority"] == "critical"
    assert issues[("broken3.com", "broken_pages")]["priority"] == "high"
    assert issues[("broken4.com", "broken_pages")]["priority"] == "critical"
    assert ("ms3000.com", "slow_server_response") not in issues
    assert issues[("ms3001.com", "slow_server_response")]["priority"] == "medium"
    assert issues[("ms6000.com", "slow_server_response")]["priority"] == "high"
    assert ("thin.com", "thin_content") in issues and ("thick.com", "thin_content") not in issues


def test_populations(issues, thresholds):
    # a page without a status is in the issues, not in the scored pages
    assert issues[("null.com", "no_meta_description")]["affected_count"] == 1
    assert ("empty.com", "no_meta_description") not in issues
    scores = {r["site"]: r for r in S.site_scores(S.site_facts(thresholds)).collect()}
    for host in ("empty.com", "null.com"):
        assert scores[host]["onpage"] == 5 and scores[host]["content_quality"] == 5
    for r in scores.values():
        for name in ("technical", "onpage", "site_structure", "ux_ui", "content_quality", "overall"):
            assert 0 <= r[name] <= 10
    assert scores["broken3.com"]["technical"] == 10 - 3 - 2 - 2 - 1
    assert scores["ms3001.com"]["technical"] == 10 - 3 - 2 - 1 - 1


def test_found_is_capped_and_ordered(issues):
    found = issues[("broken4.com", "broken_pages")]["found"]
    assert [f["url"] for f in found] == [f"https://broken4.com/x{i}" for i in range(4)]
    assert [f["status"] for f in found] == [404] * 4
    assert len(issues[("meta20.com", "no_meta_description")]["found"]) == 4
    pair = issues[("empty.com", "no_sitemap_robots")]["found"]
    assert [f["url"] for f in pair] == ["https://empty.com/sitemap.xml", "https://empty.com/robots.txt"]
    assert issues[("ms6000.com", "slow_server_response")]["found"][0]["value"] == "6.0s"
    dup = issues[("h30.com", "duplicate_missing_title")]["found"]
    assert dup[-1]["current"] == "Some title" and dup[-1]["value"] == "10"


def test_chips(spark, thresholds):
    df = I.issue_examples(I.live_or_broken(thresholds)).filter("site = 'broken4.com'")
    chips = df.filter("issue_id = 'broken_pages'").select(I.evidence_chips(F.col("found"))).first()[0]
    assert len(chips) == 4 and chips[0].asDict() == {
        "label": "https://broken4.com/x0", "detail": "status: 404"}


def test_insights_replace_own_text(spark):
    issues = spark.createDataFrame(
        [("s", "a", ["own"], ["f"]), ("s", "b", ["own"], ["f"])],
        "site string, issue_id string, impact array<string>, fix array<string>")
    insights = spark.createDataFrame(
        [("s", "a", ["theirs"], [])], "site string, issue_id string, impact array<string>, fix array<string>")
    got = {r["issue_id"]: (r["impact"], r["fix"]) for r in I.issues_with_insights(issues, insights).collect()}
    assert got == {"a": (["theirs"], ["f"]), "b": (["own"], ["f"])}


def test_counts_match_issues(thresholds):
    facts = S.site_facts(thresholds)
    issues = I.site_issues(facts, thresholds, with_examples=False)
    counts = {r["site"]: r for r in I.issue_counts(issues, S.site_strengths(facts)).collect()}
    for r in issues.groupBy("site").count().collect():
        c = counts[r["site"]]
        assert c["critical"] + c["high"] + c["medium"] + c["low"] == r["count"]
    assert len(counts) == facts.count()


def test_strict_collections(spark):
    rows = [(i, f"https://c.com/category/{i}/", page(title=f"t{i}"), 200, 0) for i in range(5)]
    f = reuse(page_features(spark.createDataFrame(rows, SCHEMA)), "strict")
    facts = S.site_facts(f)
    ids = lambda strict: {s["id"] for s in S.site_strengths(facts, strict=strict).first()["strengths"]}
    assert "collections" in ids(False) and "collections" not in ids(True)
    assert S.page_type_counts(f).first()["collection"] == 5
    assert S.page_type_counts(f, strict=True).first()["collection"] == 0
    assert len(S.recommended_sitemap(f).first()["collections"]) == 5
    assert S.recommended_sitemap(f, strict=True).first()["collections"] == []
    by_id = lambda strict: {r["issue_id"] for r in I.site_issues(facts, f, strict=strict).collect()}
    assert "no_breadcrumb" in by_id(False) and "no_breadcrumb" not in by_id(True)


def test_top_k_on_a_hot_group(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias("site"),
        ((F.col("id") * 7919) % 30_011).alias("v"), "id").repartition(13)
    got = {}
    for r in top_k(df, ["site"], [F.col("v").desc(), F.col("id")], 4).collect():
        got.setdefault(r["site"], {})[r["rank"]] = r["id"]
    want = {}
    for r in df.collect():
        want.setdefault(r["site"], []).append((-r["v"], r["id"]))
    assert {s: [g[i] for i in sorted(g)] for s, g in got.items()} == {
        s: [i for _, i in sorted(w)[:4]] for s, w in want.items()}
    lists = collect_ranked(top_k(df, ["site"], [F.col("id")], 3), ["site"], F.col("id"), "ids")
    assert lists.filter("site = 'hot'").first()["ids"] == [0, 3, 6]


def test_group_limit_is_applied_before_the_exchange(spark, thresholds):
    plan = top_k(thresholds.select("site", "page_id"), ["site"], [F.col("page_id")], 5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_result_does_not_depend_on_partitioning(spark, data_dir):
    pages = spark.read.parquet(f"{data_dir}/pages.parquet")
    out = []
    for n in (1, 7):
        f = reuse(page_features(pages.repartition(n)), "part")
        facts = S.site_facts(f)
        out.append([
            sorted(map(str, x.collect())) for x in (
                S.site_scores(facts), I.site_issues(facts, f).drop("found"), K.keyword_frequency(f),
                R.top_pages(f).select("site", "rank", "page_id"), K.token_cannibalization(f))])
    assert out[0] == out[1]


def test_tokens(spark):
    df = spark.createDataFrame(
        [("The Best-Price | of a Shoe",), ("靴の店",), ("รองเท้า สุขภาพ",), (None,)], "t string")
    got = [tuple(r) for r in df.select(K.tokens(F.col("t")), K.bigrams(F.col("t"))).collect()]
    assert got[0] == (["the", "best", "price", "of", "shoe"], ["best price", "price of", "of shoe"])
    assert got[1] == (["靴の", "の店", "靴の店"], [])
    assert got[2] == (["รองเท้า", "สุขภาพ"], ["รองเท้า สุขภาพ"])
    assert got[3] == ([], [])


def test_worst_own_position_and_gaps(spark):
    own = spark.createDataFrame(
        [("s", "Shoe", 3), ("s", "shoe", 9), ("s", "hat", None)], "site string, keyword string, position int")
    theirs = spark.createDataFrame(
        [("s", "c", "SHOE", 1, 10), ("s", "c", "hat", 2, None), ("s", "c", "bag", 3, 5)],
        "site string, competitor string, keyword string, position int, search_volume long")
    known = K.competitor_keywords(theirs, own)
    assert {r["keyword"]: r["own_position"] for r in known.collect()} == {"SHOE": 9, "hat": None, "bag": None}
    assert [r["keyword"] for r in K.keyword_gaps(known).orderBy("rank").collect()] == ["bag", "hat"]


def test_frontier_order(spark):
    urls = ["/", "/product/a/", "/category/a/", "/service/a/", "/about", "/blog/a/", "/x", "/x/y",
            "/i.png", "/z?utm_source=1", "/z?a=1&ref=b"]
    df = spark.createDataFrame([("s.com", "https://www.s.com" + u) for u in urls]
                               + [("s.com", "https://t.com/")], "site string, url string")
    got = [r["url"].split(".com")[1] for r in R.crawl_frontier(df).orderBy("rank").collect()]
    assert got == ["/", "/product/a/", "/category/a/", "/service/a/", "/about", "/blog/a/", "/x", "/x/y"]
    assert R.crawl_frontier(df, cap=2).count() == 2


def test_near_identical_pages_are_held_to_three(spark):
    rows = [(i, f"https://s.com/p{i}", page(), 200, 0) for i in range(6)]
    rows.append((9, "https://s.com/", page(words="short"), 200, 0))
    f = page_features(spark.createDataFrame(rows, SCHEMA))
    got = [r["page_id"] for r in R.top_pages(f).orderBy("rank").collect()]
    assert got == [9, 0, 1, 2]


def test_whole_audit(spark, data_dir):
    pages = spark.read.parquet(f"{data_dir}/pages.parquet")
    sitemaps = spark.createDataFrame([], "site string, url string, status int, xml string")
    robots = spark.createDataFrame([], "site string, status int, content string")
    tables = site_audit(pages, sitemaps=sitemaps, robots=robots)
    n_sites = tables["site_facts"].count()
    for name in ("site_scores", "site_summary", "site_strengths", "issue_counts", "recommended_sitemap"):
        assert tables[name].count() == n_sites, name
    assert tables["keyword_frequency"].count() >= 0
    assert audit_overview(pages).select("site").distinct().count() == n_sites


def test_repeated_title_words_are_those_of_live_pages(spark):
    rows = site_rows("a.com", [(f"/l{i}", page(title="alpha live"), 200, 0) for i in range(3)]
                     + [(f"/m{i}", page(title="missing notfound"), 404, 0) for i in range(8)])
    f = page_features(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA))
    found = [r for r in I.site_issues(S.site_facts(f), f).collect() if r["issue_id"] == "keyword_cannibalization"]
    assert [x["label"] for x in found[0]["found"]] == ['"alpha"', '"live"'] and found[0]["affected_count"] == 6


def test_sitemaps_without_robots(spark):
    pages = spark.createDataFrame([(1, "https://a.com/x", page(), 200, 0)], SCHEMA)
    maps = spark.createDataFrame(
        [("a.com", "https://a.com/sitemap.xml", 200, "<urlset><url><loc>https://a.com/y</loc></url></urlset>")],
        "site string, url string, status int, xml string")
    tables = site_audit(pages, sitemaps=maps)
    assert tables["site_facts"].first()["sitemap_found"]
    assert tables["discovered_urls"].filter("url = 'https://a.com/y'").count() == 1
