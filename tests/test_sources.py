import json
import random

from pyspark.sql import functions as F

from sitewright.operators import competitors as C
from sitewright.operators import costs
from sitewright.operators.rivals import site_rivals
from sitewright.sources import serp
from sitewright.sources.pages import with_page_defaults
from sitewright.sources.sitemaps import robots_facts, site_sitemaps


def urlset(*urls, lastmod=None):
    date = f"<lastmod>{lastmod}</lastmod>" if lastmod else ""
    return "<urlset>" + "".join(f"<url><loc> {u} </loc>{date}</url>" for u in urls) + "</urlset>"


def index(*urls):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


def test_sitemaps_and_robots(spark):
    a, b, d = "https://www.a.com", "https://b.com", "https://d.com"
    maps = [
        # declared file is empty of own URLs, so the usual name is taken; indexes are followed to any depth
        ("a.com", f"{a}/declared.xml", 200, urlset("https://other.org/x")),
        ("a.com", f"{a}/sitemap.xml", 200, index(f"{a}/s1.xml", f"{a}/s2.xml", f"{a}/gone.xml")),
        ("a.com", f"{a}/s1.xml", 200, urlset(f"{a}/1", f"{a}/1", f"{a}/pic.PNG", "https://a.com/2")),
        ("a.com", f"{a}/s2.xml", 200, index(f"{a}/s3.xml")),
        ("a.com", f"{a}/s3.xml", 200, index(f"{a}/s4.xml").replace("</s", f"<loc>{a}/beside</loc></s")
         + "<lastmod>2024-02-03</lastmod>"),
        ("a.com", f"{a}/s4.xml", 200, urlset(f"{a}/below")),
        ("b.com", f"{b}/sitemap.xml", 404, urlset(f"{b}/1")),
        ("b.com", f"{b}/wp-sitemap.xml", 200, urlset(f"{b}/1", lastmod=" 2024-01-01 ")),
        ("b.com", f"{b}/post-sitemap.xml", 200, urlset(f"{b}/2")),
        ("d.com", f"{d}/sitemap.xml", 200, "<html>no map</html>"),
    ]
    robots = [
        ("a.com", 200, f"User-agent: *\nSitemap: {a}/declared.xml\nDisallow: /private \ndisallow:\nDisallow: /tmp"),
        ("b.com", 404, "Sitemap: x"), ("d.com", 200, ""),
    ]
    maps = spark.createDataFrame(maps, "site string, url string, status int, xml string")
    robots = spark.createDataFrame(robots, "site string, status int, content string")
    facts, urls = site_sitemaps(maps, robots)
    got = {r["site"]: r for r in facts.collect()}
    assert set(got) == {"a.com", "b.com"}
    assert got["a.com"]["sitemap_url"] == f"{a}/sitemap.xml" and got["a.com"]["sitemap_lastmod"] == "2024-02-03"
    assert got["b.com"]["sitemap_url"] == f"{b}/wp-sitemap.xml" and got["b.com"]["sitemap_lastmod"] == "2024-01-01"
    lists = {}
    for r in urls.collect():
        lists.setdefault(r["site"], set()).add(r["url"])
    assert lists == {"a.com": {f"{a}/1", "https://a.com/2", f"{a}/below"}, "b.com": {f"{b}/1"}}
    assert got["a.com"]["sitemap_url_count"] == 3
    rob = {r["site"]: r for r in robots_facts(robots).collect()}
    assert rob["a.com"]["robots_found"] and rob["a.com"]["sitemap_declared"]
    assert rob["a.com"]["disallowed_paths"] == ["/private", "/tmp"]
    assert not rob["b.com"]["robots_found"] and not rob["b.com"]["sitemap_declared"]
    assert not rob["d.com"]["robots_found"]


def test_page_defaults(spark):
    df = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    assert with_page_defaults(df).first().asDict() == {
        "page_id": 1, "url": "u", "html": "h", "status": 200, "fetch_ms": 0, "final_url": None,
        "fetch_error": None}
    kept = with_page_defaults(df.withColumn("status", F.lit(None).cast("int")))
    assert kept.first()["status"] is None


def response(result, message="Ok.", cost=0.02):
    return json.dumps({"cost": cost, "tasks": [{"status_message": message, "result": result}]})


def responses(spark, rows):
    return spark.createDataFrame(rows, "target string, response string")


def ranked_item(keyword, rank, volume=None, intent=None):
    item = {"keyword_data": {"keyword": keyword, "keyword_info": {"search_volume": volume}},
            "ranked_serp_element": {"serp_item": {"rank_absolute": rank, "url": "https://x/" + str(rank)}}}
    if intent:
        item["keyword_data"]["search_intent_info"] = {"main_intent": intent}
    return item


def test_ranked_keywords(spark):
    ranks = [3, 4, 10, 11, 20, 21, None]
    items = [ranked_item(f"k{i}", r, 10 * i, "commercial" if i == 0 else None) for i, r in enumerate(ranks)]
    items.insert(1, ranked_item("  ", 2))
    df = responses(spark, [("a.com", response([{"items": items}])),
                           ("b.com", response([{"items": items}], "Invalid Field")),
                           ("c.com", '{"tasks": []}'), ("d.com", "not json"),
                           ("e.com", response([{"items": [ranked_item(f"w{i}", 1) for i in range(60)]}]))])
    rows = serp.ranked_keywords(df)
    a = rows.filter("target = 'a.com'").orderBy("at").collect()
    assert [r["priority"] for r in a] == ["High", "Medium", "Medium", "Low", "Low", "Low", "Low"]
    assert [r["suggested_action"] for r in a] == [
        "protect", "improve", "improve",
        "refresh", "refresh",
        "support", "create"]
    assert a[0]["intent"] == "commercial" and a[1]["intent"] == "unknown"
    assert {r["target"]: r["count"] for r in rows.groupBy("target").count().collect()} == {
        "a.com": 7, "e.com": 60}


def test_ideas_volumes_backlinks(spark):
    idea = {"keyword": "k", "keyword_info": {"search_volume": 5, "cpc": 0.5, "competition": 0.1,
            "monthly_searches": [{"month": 1, "year": 2024, "search_volume": 7}]},
            "keyword_properties": {"keyword_difficulty": 70}}
    df = responses(spark, [("a", response([{"items": [idea] * 40}])), ("b", response(None))])
    rows = serp.keyword_ideas(df)
    first = rows.first()
    assert rows.count() == 40 and first["keyword_difficulty"] == 70 and first["intent"] == "unknown"
    assert first["monthly_trend"][0].asDict() == {"month": 1, "year": 2024, "volume": 7}
    vols = serp.search_volumes(responses(spark, [
        ("a", response([{"keyword": "x", "search_volume": None}, {"keyword": "y", "search_volume": 3}]))]))
    assert [(r["keyword"], r["search_volume"], r["monthly_trend"]) for r in vols.orderBy("at").collect()] == [
        ("x", None, []), ("y", 3, [])]
    links = serp.backlink_summaries(responses(spark, [
        ("a", response([{"backlinks": 9, "rank": 4}])), ("b", response([])), ("c", response([{}], "Error x"))]))
    assert [tuple(r) for r in links.collect()] == [("a", 9, 0, 0, 4)]
    table = C.keyword_table(spark.createDataFrame(
        [("t", f"k{i}", None if i == 0 else i) for i in range(30)], "target string, keyword string, search_volume long"))
    assert table.count() == 25 and table.filter("rank = 1").first()["keyword"] == "k29"


def test_competitor_report(spark):
    domains = ["me.com", "facebook.com", "x.go.th", "c1.com", "c2.com", "c3.com", "c4.com", "c5.com", "c6.com"]
    items = [{"domain": d, "intersections": i, "missing_keywords_count": 3 * i} for i, d in enumerate(domains)]
    items[3].update(intersections=0, missing_keywords_count=0)
    comps = serp.competitor_domains(responses(spark, [("me.com", response([{"items": items}]))]))
    theirs = serp.ranked_keywords(responses(spark, [
        (d, response([{"items": [ranked_item(f"k{i}", i + 1, i) for i in range(25)]}]))
        for d in ("c1.com", "c4.com")]))
    own = serp.ranked_keywords(responses(spark, [
        ("me.com", response([{"items": [ranked_item("K0", 5), ranked_item("k0", 8)]
                              + [ranked_item(f"k{i}", 9) for i in range(16, 25)]}]))]))
    got = C.competitor_report(comps, theirs, own).orderBy("rank").collect()
    assert [r["domain"] for r in got] == ["c1.com", "c2.com", "c3.com", "c4.com", "c5.com", "c6.com"]
    assert [r["estimated_visibility"] for r in got] == [0, 25, 25, 25, 25, 25]
    assert C.competitor_report(comps, theirs, own, competitors=5).count() == 5
    one = got[0]
    assert len(one["top_keywords"]) == 20 and one["top_keywords"][0]["own_position"] == 8
    assert one["keyword_gaps"] == [f"k{i}" for i in range(15, 5, -1)]
    assert one["suggested_action"] == "fill_gaps"
    assert [(r["n_keywords"], r["n_gaps"]) for r in got] == [(25, 15), (0, 0), (0, 0), (25, 15), (0, 0), (0, 0)]
    assert got[4]["top_keywords"] == [] and got[4]["suggested_action"] == "watch"


def test_rivals_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    words = [(f"s{i}", f"w{int(rng.paretovariate(0.5)) % 400}") for i in range(70) for _ in range(rng.choice([1, 3, 40]))]
    words += [(f"s{i}", "everywhere") for i in range(70)] + [("alone", "own"), (None, "w1"), ("s1", None)]
    sets = {}
    for site, word in words:
        if site and word:
            sets.setdefault(site, set()).add(word)
    weight = {w: 1_000_000 // sum(w in x for x in sets.values()) for x in sets.values() for w in x}
    want = []
    for a, x in sets.items():
        near = sorted((-sum(weight[w] for w in x & y), b) for b, y in sets.items() if b != a and x & y)[:4]
        want += [(a, i + 1, b, -n, len(x & sets[b]), len(sets[b] - x)) for i, (n, b) in enumerate(near)]
    df = spark.createDataFrame(words, "site string, keyword string")
    for rounds in ((2, 5, 20), (1000,), ()):
        got = site_rivals(df, cap=4, rounds=rounds).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert site_rivals(df.limit(0)).count() == 0


def test_sitemap_trees_of_any_size(spark):
    a = "https://a.com"
    rows = [("a.com", f"{a}/sitemap.xml", 200, index(f"{a}/m0.xml", f"{a}/many.xml"))]
    rows += [("a.com", f"{a}/m{i}.xml", 200, index(f"{a}/m{i + 1}.xml", f"{a}/sitemap.xml")) for i in range(6)]
    rows += [("a.com", f"{a}/m6.xml", 200, urlset(f"{a}/deep", lastmod="2024-05-05"))]
    rows += [("a.com", f"{a}/many.xml", 200, index(*[f"{a}/p{i}.xml" for i in range(25)], f"{a}/many.xml"))]
    rows += [("a.com", f"{a}/p{i}.xml", 200, urlset(f"{a}/page{i}", lastmod="2024-01-01")) for i in range(25)]
    maps = spark.createDataFrame(rows, "site string, url string, status int, xml string")
    robots = spark.createDataFrame([], "site string, status int, content string")
    facts, urls = site_sitemaps(maps, robots)
    assert {r["url"] for r in urls.collect()} == {f"{a}/deep"} | {f"{a}/page{i}" for i in range(25)}
    assert [(r["sitemap_url_count"], r["sitemap_lastmod"]) for r in facts.collect()] == [(26, "2024-05-05")]
    assert site_sitemaps(maps.limit(0), robots)[0].count() == 0


def test_markets_and_bands(spark):
    df = spark.createDataFrame([(["th-TH", "en"],), ([],), (["fr"],), (["ja", "zh-TW", "ko"],)], "l array<string>")
    got = [[(m["location"], m["language"]) for m in r[0]] for r in df.select(C.markets(F.col("l"))).collect()]
    assert got == [[("Thailand", "Thai"), ("Thailand", "English")], [("Thailand", "English")],
                   [("Thailand", "English")],
                   [("Japan", "Japanese"), ("Taiwan", "Chinese Traditional"), ("South Korea", "Korean")]]
    nums = spark.createDataFrame([(70,), (60,), (40,), (30,), (3,), (None,)], "v int")
    c = F.col("v")
    got = [tuple(r) for r in nums.select(C.difficulty_band(c), C.authority_band(c), C.position_band(c)).collect()]
    assert got == [("high", "high", "beyond"), ("medium", "high", "beyond"), ("medium", "medium", "beyond"),
                   ("low", "medium", "beyond"), ("low", "low", "top3"), ("unknown", "unknown", "unknown")]


def test_grounding_text(spark):
    text = ("Top: https://www.Alpha.com and beta.co.th\nme.com is ours, alpha.com again\n\n"
            "google.com facebook.com gamma.net delta.io eps.org zeta.org\nLine about SHOES here")
    df = spark.createDataFrame([(text, ["shoes", "missing", "none"], ["a", "b"], ["b", "c"])],
                               "t string, k array<string>, s1 array<string>, s2 array<string>")
    every = df.select(C.domains_in_text(F.col("t"), F.lit("me.com"))).first()[0]
    assert [x["domain"] for x in every] == ["alpha.com", "beta.co.th", "gamma.net", "delta.io", "eps.org", "zeta.org"]
    r = df.select(C.domains_in_text(F.col("t"), F.lit("me.com"), cap=5), C.keyword_lines(F.col("t"), F.col("k")),
                  C.merged_sources(F.col("s1"), F.col("s2"))).first()
    assert [x["domain"] for x in r[0]] == ["alpha.com", "beta.co.th", "gamma.net", "delta.io", "eps.org"]
    assert r[0][0]["name"] == "Alpha" and r[0][1]["snippet"].startswith("Top: ")
    assert [tuple(x) for x in r[1]] == [("shoes", "Line about SHOES here"),
                                        ("missing", "me.com is ours, alpha.com again")]
    assert r[2] == ["a", "b", "c"]


def test_costs(spark):
    usage = spark.createDataFrame(
        [(1, "gemini-2.5-flash", 1_000_000, 1_000_000, 0), (1, "unknown", None, None, 4002), (2, "gemini-2.5-pro", 0, 0, 10)],
        "scan_id long, model string, input_tokens long, output_tokens long, prompt_chars long")
    got = {(r["scan_id"], r["model"]): r for r in costs.model_costs(usage).collect()}
    assert abs(got[(1, "gemini-2.5-flash")]["cost_usd"] - 0.75) < 1e-9
    est = got[(1, "unknown")]
    assert est["is_estimated"] and est["input_tokens"] == 1001 and est["output_tokens"] == 4000
    assert abs(est["cost_usd"] - (1001 / 1e6 * 1.25 + 0.04)) < 1e-9
    calls = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.25), (3, "b", 1.0)], "scan_id long, api string, cost_usd double")
    assert {(r["scan_id"], r["api"]): r["cost_usd"] for r in costs.api_costs(calls).collect()} == {
        (1, "a"): 0.75, (3, "b"): 1.0}
    total = {r["scan_id"]: r for r in costs.scan_costs(costs.model_costs(usage), calls).collect()}
    assert set(total) == {1, 2, 3} and abs(total[3]["total_cost_thb"] - 34) < 1e-9


def test_answer_visibility(spark):
    rows = []
    for site, brand in (("low", 2), ("mid", 3), ("high", 6)):
        rows += [(site, f"p{i}", i < brand, "High" if i % 2 else "Low") for i in range(10)]
    df = spark.createDataFrame(rows, "site string, prompt string, brand_appears boolean, citation_gap string")
    got = {r["site"]: r for r in costs.answer_visibility(df).collect()}
    assert [got[s]["brand_mention_status"] for s in ("low", "mid", "high")] == ["Low", "Medium", "High"]
    assert got["mid"]["faq_opportunities"] == 8 and got["mid"]["entity_clarity_score"] == 64
    assert got["mid"]["citation_source_gaps"] == 5 and got["mid"]["prompt_opportunities"] == 7
