"""Tables that the given data lacks, made from it by rule so that they grow with it.

Page markup with head tags, headings, media and structured data is built around the documents;
search exports around title tokens; answers, usage and probes around conversations and events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions.text import escape_html

_PATH = """CASE id % 13 WHEN 0 THEN '/' WHEN 1 THEN concat('/products/item-', id, '/')
  WHEN 2 THEN concat('/category/c', id, '/') WHEN 3 THEN concat('/service/s-', id, '/')
  WHEN 4 THEN concat('/faq-', id) WHEN 5 THEN concat('/about-', id)
  WHEN 6 THEN concat('/contact-', id) WHEN 7 THEN concat('/podcast/', id, '/')
  WHEN 8 THEN concat('/blog/post-', id, '/') WHEN 9 THEN concat('/policy-', id)
  WHEN 10 THEN concat('/a/b/c/d/e-', id) WHEN 11 THEN concat('/x-', id)
  ELSE concat('/news/', id, '/') END"""


def _many(n: str, item: str) -> str:
    return (f"CASE WHEN {n} > 0 THEN array_join(transform(sequence(1, cast({n} AS int)), "
            f"j -> {item}), '\n') ELSE '' END")


_HEAD = (
    "CASE WHEN id % 9 = 8 THEN '' WHEN id % 5 = 0 THEN concat('<title>Shared title ', lang, '</title>')"
    " ELSE concat('<title>Page ', id, ' about ', source, ' &amp; more</title>') END",
    "CASE WHEN id % 3 <> 0 THEN concat('<meta name=\"description\" content=\"Summary of ', id, ' in ', lang, '\">')"
    " WHEN id % 6 = 3 THEN concat('<meta content=''Short ', id, ''' name=''description''/>') ELSE '' END",
    "CASE WHEN id % 10 = 3 THEN '<meta name=robots content=\"noindex, nofollow\">' ELSE '' END",
    "CASE id % 4 WHEN 1 THEN concat('<link rel=\"canonical\" href=\"', url, '\">')"
    " WHEN 2 THEN concat('<link href=\"https://shop', k, '.example.com/other/', id, '\" rel=\"canonical\">')"
    " WHEN 3 THEN concat('<link rel=\"canonical\" href=\"https://other.example.net/', id, '\">') ELSE '' END",
    "CASE WHEN id % 8 <> 0 THEN '<meta name=\"viewport\" content=\"width=device-width\">' ELSE '' END",
    "CASE WHEN id % 6 IN (1, 2) THEN concat('<meta property=\"og:title\" content=\"Social ', id, '\">') ELSE '' END",
    "CASE WHEN id % 6 = 2 THEN '<meta property=\"og:description\" content=\"a > b\">' ELSE '' END",
    "CASE WHEN id % 6 IN (2, 3) THEN '<meta property=\"og:image\" content=\"/i.png\">' ELSE '' END",
    "CASE WHEN id % 5 = 1 THEN '<link rel=\"alternate\" hreflang=\"th\" href=\"/th\"><link rel=\"alternate\" hreflang=\"en\" href=\"/en\">' ELSE '' END",
    "'<style>:root{--brand-color: #336699; --bg-color:#ffffff} body{background:#000000;background-color: #abcdef}</style>'",
    "CASE id % 12 WHEN 0 THEN '<script type=\"application/ld+json\">{\"@type\":\"Organization\",\"@graph\":[{\"@type\":\"WebSite\"},{\"@type\":\"BreadcrumbList\"}]}</script>'"
    " WHEN 1 THEN '<script type=\"application/ld+json\">{\"@type\":[\"Product\",\"Thing\"]}</script>'"
    " WHEN 2 THEN '<script type=\"application/ld+json\">{\"@graph\":[{\"@type\":\"FAQPage\"}]}</script>'"
    " WHEN 3 THEN '<script type=\"application/ld+json\">{\"@type\":\"BlogPosting\"}</script>'"
    " WHEN 4 THEN '<script type=\"application/ld+json\">{\"@type\":\"Organization\",</script>'"
    " WHEN 5 THEN '<script type=\"application/ld+json\">{\"@type\":\"Place\",\"@graph\":[{\"@graph\":[{\"@type\":\"City\",\"@graph\":[{\"@graph\":[{\"@graph\":[{\"@type\":\"Event\"}]}]}]},{\"@type\":\"Map\"}]}]}</script>' ELSE '' END",
)
_MAIN = (
    "CASE WHEN id % 9 = 4 THEN '' WHEN id % 4 = 0 THEN concat('<h1 class=\"t\">Short ', id, '</h1>')"
    " ELSE concat('<h1>Heading number ', id, '\n of <b>shop</b> ', k, '</h1>') END",
    "CASE WHEN id % 9 = 5 THEN '<h1>Second</h1>' ELSE '' END",
    _many("id % 4", "concat('<h2>Part ', j, '</h2>')"),
    _many("id % 3", "concat('<h3>Step ', j, '</h3>')"),
    "concat('<p>', body, '</p>')",
    _many("id % 4", "CASE j WHEN 1 THEN '<img src=\"a.png\" alt=\"A view\">' WHEN 2 THEN '<img alt=\"\" src=\"b.png\">' ELSE '<img src=\"c.png\">' END"),
    "CASE WHEN id % 5 = 2 THEN '<table><tr><td>Cell</td></tr></table>' ELSE '' END",
    "CASE WHEN id % 6 = 4 THEN '<ol><li>One</li><li>Two</li><li>Three</li></ol>' ELSE '' END",
    "CASE WHEN id % 4 = 1 THEN '<button type=submit>Buy now</button>' ELSE '' END",
    "CASE WHEN id % 8 = 3 THEN '<a class=\"btn-main\" href=\"/buy\">Order here</a>' ELSE '' END",
    "CASE WHEN id % 16 = 5 THEN '<details>Qa</details><details>Qb</details><details>Qc</details><details>Qd</details>' ELSE '' END",
    "CASE WHEN id % 9 = 2 THEN '<div class=\"toc-box\">Contents</div>' ELSE '' END",
    "CASE WHEN id % 5 = 3 THEN '<span class=\"post-author\">By Ann</span>' ELSE '' END",
    "CASE WHEN id % 7 = 2 THEN '<time datetime=\"2024-01-02\">2 January</time>' ELSE '' END",
    _many("id % 5", "concat('<a href=\"/products/p', j, '\">Product ', j, '</a>')"),
    "CASE WHEN id % 3 = 0 THEN '<a rel=\"nofollow\" href=\"https://partner.example.org/x\">Partner</a>' ELSE '' END",
    "CASE WHEN id % 4 = 2 THEN concat('<a href=\"https://sub.', host, '/s\">Sub</a>') ELSE '' END",
    "CASE WHEN id % 2 = 0 THEN '<a href=\"mailto:a&#64;b.example\">Mail</a>' ELSE '' END",
    "CASE WHEN id % 6 = 5 THEN 'Call 0812345678' ELSE '' END",
)
_NAV = (
    "concat('<a href=\"/\">Home</a><a href=\"/items\">Item ', k, '</a>',"
    " CASE k WHEN 3 THEN '<a href=\"/raw\">RAW_NAME</a>' WHEN 5 THEN '<a href=\"/menu\">{menu}</a>' ELSE '' END)"
)


_ZONE = """get(CASE id % 6
  WHEN 1 THEN named_struct('open', '<div role="main"><div>', 'close', '</div></div>')
  WHEN 2 THEN named_struct('open', '<div id="content">', 'close', '</div>')
  WHEN 3 THEN named_struct('open', '<div class="box post-content"><div class="inner">', 'close', '</div></div>')
  WHEN 4 THEN named_struct('open', '<article class="a">', 'close', '</article>')
  WHEN 5 THEN named_struct('open', '<section class="entry-content">', 'close', '</section>')
  ELSE named_struct('open', '<main>', 'close', '</main>') END, '{}')""".replace("get(", "(").replace(", '{}')", ").{}")


def marked_up_pages(documents: DataFrame) -> DataFrame:
    """A page per document on seven shops, with every kind of markup the features look at."""
    e = F.expr
    df = documents.select(F.col("doc_id").alias("id"), "lang", "source",
                          escape_html(F.col("text")).alias("body")).withColumn("k", e("id % 7"))
    df = df.withColumn("host", e(
        "concat(CASE WHEN id % 2 = 0 THEN 'www.' ELSE '' END, 'shop', k, '.example.com')"))
    df = df.withColumn("url", e(f"concat('https://', host, {_PATH})"))
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head>"), F.concat_ws("\n", *[e(x) for x in _HEAD]),
        F.lit("</head><body><header><nav>"), e(_NAV), F.lit("</nav></header>\n"), e(_ZONE.format("open")), F.lit("\n"),
        F.concat_ws("\n", *[e(x) for x in _MAIN]),
        F.lit("\n"), e(_ZONE.format("close")), F.lit("\n<footer>Footer text</footer></body></html>"))
    return df.select(
        F.col("id").alias("page_id"), "url",
        F.when(e("id % 17 <> 16"), html).alias("html"),
        e("CASE id % 11 WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 200 END").cast("int").alias("status"),
        e("(id * 37) % 7000").cast("bigint").alias("fetch_ms"))


_ARTICLE_HEAD = (
    "CASE id % 8 WHEN 0 THEN '' WHEN 1 THEN concat('<title>Tip ', id, '</title>')"
    " WHEN 2 THEN concat('<title>A very long title about topic ', id, ' that goes on for more than sixty characters</title>')"
    " WHEN 3 THEN '<title>Topic overview</title>' ELSE concat('<title>Guide to topic ', id, ' for readers</title>') END",
    "CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('<meta name=\"description\" content=\"', trim(repeat('long words ', 16)), '\">')"
    " ELSE concat('<meta name=\"description\" content=\"Summary ', id, '\">') END",
    "CASE WHEN id % 9 = 4 THEN '<meta name=\"robots\" content=\"noindex, follow\">' ELSE '' END",
    "CASE id % 4 WHEN 1 THEN concat('<link rel=\"canonical\" href=\"https://mag', k, '.example.com/x\">')"
    " WHEN 2 THEN concat('<link rel=\"canonical\" href=\"https://other.example.net/', id, '\">') ELSE '' END",
    "CASE WHEN id % 3 = 1 THEN concat('<meta property=\"og:title\" content=\"Social ', id, '\">') ELSE '' END",
    "CASE id % 10 WHEN 0 THEN '<script type=\"application/ld+json\">{\"@type\":\"FAQPage\"}</script>'"
    " WHEN 1 THEN '<script type=\"application/ld+json\">{\"@type\":[\"Article\",\"Thing\"]}</script>'"
    " WHEN 5 THEN '<script type=\"application/ld+json\">{\"@type\":\"WebPage\",\"@graph\":[{\"@graph\":[{\"@graph\":[{\"@graph\":[{\"@type\":\"Organization\"}]}]}]}]}</script>' ELSE '' END",
)
_ARTICLE_BODY = (
    "CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN concat('<h1>Topic ', id, ' explained</h1>') ELSE '<h1>A general view</h1>' END",
    _many("id % 5", "concat('<h2>Part ', j, '</h2>')"),
    "CASE id % 9 WHEN 1 THEN '<h2>Process and timeline</h2>' WHEN 2 THEN '<h2>Mistakes to avoid</h2>' ELSE '' END",
    "CASE WHEN id % 13 = 5 THEN '<h2>FAQ</h2>' ELSE '' END",
    _many("id % 3", "concat('<h3>Step ', j, '</h3>')"),
    "CASE WHEN id % 11 = 3 THEN '<div class=\"faq\">Answers</div>' ELSE '' END",
    "concat('<p>', body, '</p>')",
    _many("id % 3", "concat('What is topic number ', j, ' about?')"),
    "CASE WHEN id % 7 = 3 THEN 'In 2011 and 2012 and 2013 and 2012 it began.' ELSE '' END",
    "CASE id % 12 WHEN 3 THEN 'This is a 100% success story.' WHEN 9 THEN 'We guarantee every visa.' ELSE '' END",
    "CASE WHEN id % 4 = 3 THEN 'Contact us today.' ELSE '' END",
    "CASE WHEN id % 9 = 6 THEN 'Call 0812345678 now.' ELSE '' END",
    "CASE WHEN id % 4 = 2 THEN '<table><tr><td>Cell</td></tr></table>' ELSE '' END",
    "CASE WHEN id % 5 = 3 THEN '<ul>\n<li>One</li>\n<li>Two</li>\n</ul>' ELSE '' END",
    _many("id % 6", "'<img src=\"a.png\">'"),
    "CASE WHEN id % 2 = 0 THEN '<img src=\"b.png\" alt=\"A view\">' ELSE '' END",
    "CASE WHEN id % 4 = 1 THEN concat('<span class=\"author\">Ann ', id, '</span>') ELSE '' END",
    "CASE id % 5 WHEN 2 THEN '<time datetime=\"2024-03-01\">1 March</time>' WHEN 4 THEN concat('<span class=\"post-date\">May ', id, '</span>') ELSE '' END",
    _many("id % 4", "concat('<a href=\"/p', j, '\">Page ', j, '</a>')"),
    "CASE WHEN id % 8 = 7 THEN '<a href=\"/w1\">click here</a>\n<a href=\"/w2\">click here</a>\n<a href=\"/w3\">click here</a>' ELSE '' END",
    "CASE WHEN id % 6 = 1 THEN '<a href=\"https://embassy.example.gov/v\">Embassy</a>' ELSE '' END",
    "CASE WHEN id % 6 = 2 THEN '<a rel=\"nofollow\" href=\"https://ads.example.org/z\">Partner</a>' ELSE '' END",
)


def marked_up_articles(documents: DataFrame) -> DataFrame:
    """An article around each document, with every kind of markup and wording that scores and rules look at."""
    e = F.expr
    df = documents.select(F.col("doc_id").alias("id"), escape_html(F.col("text")).alias("body")).withColumn("k", e("id % 5"))
    html = F.concat(F.lit("<!DOCTYPE html><html><head>"), F.concat_ws("\n", *[e(x) for x in _ARTICLE_HEAD]), F.lit("</head><body>\n"),
                    F.concat_ws("\n", *[e(x) for x in _ARTICLE_BODY]), F.lit("\n</body></html>"))
    return df.select(
        F.col("id").alias("article_id"), e("concat('https://mag', k, '.example.com/a/', id)").alias("url"),
        e("CASE WHEN id % 3 <> 0 THEN concat('https://mag', k, '.example.com/final/', id) END").alias("final_url"), html.alias("html"),
        e("CASE WHEN id % 6 <> 0 THEN concat('topic ', id) END").alias("detected_keyword"),
        e("CASE (id div 5) % 5 WHEN 0 THEN 'Visa' WHEN 1 THEN 'Travel' WHEN 2 THEN 'Local/Service' ELSE 'General' END").alias("detected_article_type"),
        e("CASE (id div 3) % 3 WHEN 0 THEN 'Thai' WHEN 1 THEN 'English' ELSE 'Thai/English mixed' END").alias("detected_language"))


_SHOP = "concat('https://shop', k, '.example.com')"
_ROOT = f"concat({_SHOP}, CASE k WHEN 0 THEN '/maps/root.xml' WHEN 2 THEN '/sitemap_index.xml' WHEN 3 THEN '/maps/second.xml' WHEN 4 THEN '/wp-sitemap.xml' ELSE '/sitemap.xml' END)"
_LEAF = f"concat({_SHOP}, '/maps/leaf-', j, CASE WHEN k = 6 THEN '' ELSE '.xml' END)"


def sitemap_files(documents: DataFrame) -> DataFrame:
    """Sitemap files of the shops: three pages to a file, five files to an index, five levels and a root over them.

    The lowest indexes name the root again.  Files also name pictures, foreign pages and pages that were never crawled.
    One shop has no sitemap, one an empty file before the full one, one files without an ending.
    """
    e, c = F.expr, F.col
    docs = documents.select(c("doc_id").alias("id")).distinct().withColumn("k", e("id % 7")).filter("k <> 5").withColumn("j", e("id div 7 div 3"))
    docs = docs.withColumn("page", e(f"concat('https://', CASE WHEN id % 2 = 0 THEN 'www.' ELSE '' END, 'shop', k, '.example.com', {_PATH})"))
    entry = e(f"concat('<url><loc>', page, '</loc>', CASE WHEN j % 4 = 1 THEN concat('<lastmod>2024-01-', lpad(j % 28 + 1, 2, '0'), '</lastmod>') ELSE '' END, '</url>',"
              f" CASE WHEN id % 10 = 0 THEN concat('<url><loc>', {_SHOP}, '/fresh/', id, '</loc></url>') ELSE '' END,"
              f" CASE WHEN id % 8 = 0 THEN concat('<url><loc>', {_SHOP}, '/a.png</loc></url><url><loc>https://elsewhere.example.net/', id, '</loc></url>') ELSE '' END)")

    def files(rows: DataFrame, keys: list[str], url: str, item: Column, tail: str = "''", tag: str = "sitemapindex") -> DataFrame:
        listed = rows.groupBy("k", *keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", item.alias("x")))), lambda r: r["x"]), "\n").alias("items"))
        return listed.select("k", e(url).alias("url"), e(f"concat('<{tag}>', items, {tail}, '</{tag}>')").alias("xml"))

    out = files(docs.withColumn("at", c("id")), ["j"], _LEAF, entry, tag="urlset")
    nodes = docs.select("k", c("j").alias("at"), e(_LEAF).alias("u")).distinct()
    for level in range(1, 6):
        up = nodes.withColumn("i", e("at div 5"))
        cycle = f"CASE WHEN k <> 6 THEN concat('<sitemap><loc>', {_ROOT}, '</loc></sitemap>') ELSE '' END" if level == 1 else "''"
        url = f"concat({_SHOP}, '/maps/l{level}-', i, '.xml')"
        out = out.unionByName(files(up, ["i"], url, e("concat('<sitemap><loc>', u, '</loc></sitemap>')"), cycle))
        nodes = up.select("k", c("i").alias("at"), e(url).alias("u")).distinct()
    out = out.unionByName(files(nodes, [], _ROOT, e("concat('<sitemap><loc>', u, '</loc></sitemap>')")))
    shops = docs.select("k").distinct()
    odd = shops.filter("k = 2").select("k", e(f"concat({_SHOP}, '/sitemap.xml')").alias("url"), F.lit("<urlset><loc>https://shop2.example.com/x</loc></urlset>").alias("xml")).unionByName(
        shops.filter("k = 3").select("k", e(f"concat({_SHOP}, '/maps/empty.xml')").alias("url"), F.lit("<urlset></urlset>").alias("xml"))).unionByName(
        shops.filter("k = 4").select("k", e(f"concat({_SHOP}, '/sitemap.xml')").alias("url"), F.lit("<html>no map</html>").alias("xml")))
    return out.unionByName(odd).select(
        e("concat('shop', k, '.example.com')").alias("site"), "url",
        F.when((c("k") == 2) & c("url").endswith("/sitemap.xml"), 404).when(c("k") == 4, 301).otherwise(200).alias("status"), "xml")


def robots_files(documents: DataFrame) -> DataFrame:
    """A robots file for each shop but one: sitemap lines, blocked paths, an empty rule, a missing file."""
    e = F.expr
    shops = documents.select(F.expr("doc_id % 7").alias("k")).distinct().filter("k <> 1")
    return shops.select(
        e("concat('shop', k, '.example.com')").alias("site"), e("CASE WHEN k = 5 THEN 404 ELSE 200 END").alias("status"),
        e(f"""CASE k WHEN 0 THEN concat('User-agent: *\nDisallow: /cart \nDisallow:\nSitemap: ', {_ROOT}, '\n')
          WHEN 3 THEN concat('sitemap: ', {_SHOP}, '/maps/empty.xml\nSITEMAP: ', {_ROOT}, '\ndisallow: /x')
          WHEN 5 THEN 'Not found' ELSE concat('User-agent: *\nDisallow: /shop', k) END""").alias("content"))


def rank_responses(ranks: DataFrame) -> DataFrame:
    """Ranked-keyword responses of a hundred keywords, from `site, keyword, position, search_volume`."""
    c = F.col
    item = F.struct(
        F.struct(
            c("keyword"), F.struct("search_volume").alias("keyword_info"),
            F.struct((c("position") * 2.0).alias("keyword_difficulty")).alias("keyword_properties"),
            F.struct(F.when(c("position") % 3 == 0, "commercial").alias("main_intent"))
            .alias("search_intent_info")).alias("keyword_data"),
        F.struct(F.struct(
            F.when(c("position") % 7 != 0, c("position")).alias("rank_absolute"),
            F.concat(F.lit("https://"), "site", F.lit("/"), "keyword").alias("url"))
            .alias("serp_item")).alias("ranked_serp_element"))
    lists = ranks.groupBy(c("site").alias("target"), F.expr("(position - 1) div 100").alias("page")).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("position", item.alias("item")))),
        lambda x: x["item"]).alias("items"))
    return lists.select("target", (c("page") * 100).alias("offset"), F.to_json(F.struct(
        F.lit(0.01).alias("cost"),
        F.array(F.struct(F.lit("Ok.").alias("status_message"),
                         F.array(F.struct("items")).alias("result"))).alias("tasks")))
        .alias("response"))


_IDEA = """named_struct('keyword', CASE WHEN id % 11 <> 0 THEN concat('topic ', id) END,
  'keyword_info', named_struct('search_volume', CASE WHEN id % 4 <> 0 THEN id * 3 % 1000 END, 'cpc', CASE WHEN id % 5 <> 0 THEN id % 7 / 2D END,
    'competition', CASE WHEN id % 3 = 1 THEN 0.5D END,
    'monthly_searches', CASE WHEN id % 6 = 1 THEN array(named_struct('month', 1, 'year', 2024, 'search_volume', id), named_struct('month', 2, 'year', 2024, 'search_volume', CAST(NULL AS BIGINT))) END),
  'keyword_properties', named_struct('keyword_difficulty', CASE WHEN id % 3 <> 0 THEN id % 101 * 1D END),
  'search_intent_info', named_struct('main_intent', CASE WHEN id % 2 = 0 THEN 'informational' END))"""
_VOLUME = """named_struct('keyword', concat('topic ', id), 'search_volume', CASE WHEN id % 4 <> 0 THEN id * 3 % 1000 END, 'cpc', id % 7 / 2D,
  'monthly_searches', CASE WHEN id % 6 = 1 THEN array(named_struct('month', 3, 'year', 2024, 'search_volume', id)) END)"""


def response_lines(documents: DataFrame) -> DataFrame:
    """Lines of response files, `value`: ideas, volumes and backlinks of five sites, five items to a response.

    Of six responses in a row one is refused, one cut off in the middle of the line, one without a task, the others fine.
    """
    e, c = F.expr, F.col
    rows = documents.select(c("doc_id").alias("id")).distinct().withColumns({"k": e("id % 5"), "b": e("id div 25")})
    listed = lambda item: F.transform(F.sort_array(F.collect_list(F.struct("id", e(item).alias("x")))), lambda r: r["x"])
    blocks = rows.groupBy("k", "b").agg(listed(_IDEA).alias("ideas"), listed(_VOLUME).alias("volumes"), F.sum("id").alias("links"), F.count("*").alias("n"))
    results = {
        "ideas": F.array(F.struct(c("ideas").alias("items"))), "volumes": c("volumes"),
        "backlinks": F.array(F.when(c("n") > 1, F.struct(c("links").alias("backlinks"), c("n").alias("referring_domains"), (c("links") % 100).alias("rank")))),
    }

    def lines(api: str, result: Column) -> Column:
        said = F.when(c("b") % 6 == 3, "Error: limit reached").otherwise("Ok.")
        task = F.struct(said.alias("status_message"), F.when(c("b") % 6 != 3, result).alias("result"))
        response = F.to_json(F.struct(F.lit(0.01).alias("cost"), F.when(c("b") % 6 == 5, F.array().cast(f"array<{task_type(task)}>"))
                                      .otherwise(F.array(task)).alias("tasks")))
        line = F.concat(e(f"concat('{{\"target\":\"site', k, '\",\"api\":\"{api}\",\"offset\":', b * 5, ',\"response\":')"), response, F.lit("}"))
        return F.when(c("b") % 6 == 4, F.expr("substring(line, 1, length(line) - 9)")).otherwise(c("line")).alias("value"), line

    def task_type(task: Column) -> str:
        return blocks.select(task.alias("t")).schema["t"].dataType.simpleString()

    out = None
    for api, result in results.items():
        value, line = lines(api, result)
        one = blocks.withColumn("line", line).select(value)
        out = one if out is None else out.unionByName(one)
    return out


def grounding_texts(documents: DataFrame) -> DataFrame:
    """Research notes around the documents: lines that name domains and topics, keywords asked for, sources."""
    e = F.expr
    return documents.select(
        F.col("doc_id").alias("scan_id"),
        e("""concat('See https://www.site', doc_id % 9, '.example.com/page and Shop', doc_id % 4, '.co.th',
          CASE WHEN doc_id % 3 = 0 THEN '\n  again site0.example and www.google.com \n' ELSE '\n\n' END,
          'About Topic ', doc_id % 6, ' and own.example', '\n', text)""").alias("text"),
        e("array('topic 1', concat('TOPIC ', doc_id % 6), 'site', 'none such', 'x', 'y', 'z')").alias("keywords"),
        e("array(concat('u', doc_id % 5), 'a', concat('u', doc_id % 3))").alias("first"),
        e("transform(sequence(1, 12), i -> concat('u', (i * doc_id) % 14))").alias("second"))


def model_usage(conversations: DataFrame) -> DataFrame:
    e = F.expr
    known = "turn % 3 <> 0"
    return conversations.select(
        F.col("conv_id").alias("scan_id"),
        e("CASE role WHEN 'user' THEN 'gemini-2.5-flash' WHEN 'assistant' THEN 'gemini-2.5-pro'"
          " ELSE 'other-model' END").alias("model"),
        e(f"CASE WHEN {known} THEN length(text) * 10 END").alias("input_tokens"),
        e(f"CASE WHEN {known} THEN length(text) END").alias("output_tokens"),
        F.length("text").alias("prompt_chars"))


def api_calls(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("scan_id"), F.col("event_type").alias("api"),
        F.col("value").alias("cost_usd"))


def prompt_probes(events: DataFrame) -> DataFrame:
    e = F.expr
    return events.select(
        F.col("user_id").cast("string").alias("site"), e("concat('prompt ', event_id)").alias("prompt"),
        e("event_type IN ('purchase', 'click') AND user_id % 3 > 0 OR event_type = 'view' AND user_id % 3 = 2")
        .alias("brand_appears"),
        e("CASE WHEN value > 20 THEN 'High' WHEN value > 5 THEN 'Medium' ELSE 'Low' END")
        .alias("citation_gap"))


_SITE_ANSWER = """to_json(named_struct(
  'salesPitchSummary', CASE WHEN id % 5 <> 1 THEN concat('Pitch ', id) END,
  'executiveSummary', CASE WHEN id % 7 <> 2 THEN 'Summary' ELSE '  ' END,
  'businessType', source, 'overallVerdict', CASE WHEN id % 11 <> 3 THEN lang END,
  'actionPlan', CASE WHEN id % 6 <> 4 THEN array('a', 'b') ELSE array() END,
  'expectedResults', named_struct('day30', array('x'),
      'day60', CASE WHEN id % 8 <> 5 THEN array('y') ELSE array() END, 'day90', array('z')),
  'contentGaps', array('gap')))"""


def site_answers(documents: DataFrame) -> DataFrame:
    """Answers as a model writes them: bare, fenced, with prose around, or cut off."""
    df = documents.select(F.col("doc_id").alias("id"), "lang", "source", "text").withColumn(
        "j", F.expr(_SITE_ANSWER))
    return df.select(F.col("id").alias("scan_id"), F.expr("""CASE id % 4
      WHEN 0 THEN j WHEN 1 THEN concat('Here it is:\n```json\n', j, '\n```\nDone.')
      WHEN 2 THEN concat('Sure. ', j, ' Anything else?')
      ELSE substring(j, 1, length(j) - 3) END""").alias("text"))


_ARTICLE_ANSWER = r"""to_json(named_struct(
  'oneSentenceTruth', CASE WHEN id % 9 <> 4 THEN concat('Truth ', id) END,
  'topProblems', transform(sequence(1, cast(2 + id % 5 AS int)), i -> concat('p', i)), 'topFixes', array('f1', 'f2', 'f3', 'f4'),
  'titleOptions', transform(sequence(1, cast(4 + id % 5 AS int)), i -> concat('t', i)), 'metaOptions', array('m1', 'm2', 'm3'),
  'h2Suggestions', array('h1', 'h2', 'h3', 'h4', 'h5', 'h6'),
  'faqSuggestions', transform(sequence(1, cast(3 + id % 7 AS int)), i -> named_struct('q', concat('q', i), 'a', 'a'))))"""
_BRIEF = r"""CASE WHEN id % 3 = 1 THEN concat('"', array_join(transform(sequence(1, cast(5 + id % 4 AS int)), i -> concat(' line ', i)), '\\n \\n'), '"')
  ELSE '["b1","b2","b3","b4","b5","b6"]' END"""


def article_answers(documents: DataFrame) -> DataFrame:
    """Article answers with lists within and beyond their bounds, a brief as text or list; bare, fenced, in prose, cut off."""
    df = documents.select(F.col("doc_id").alias("id")).withColumn("j", F.expr(_ARTICLE_ANSWER))
    df = df.withColumn("j", F.expr(f"concat(substring(j, 1, length(j) - 1), ',\"rewriteBrief\":', {_BRIEF}, '}}')"))
    return df.select(F.col("id").alias("scan_id"), F.expr("""CASE id % 4
      WHEN 0 THEN j WHEN 1 THEN concat('```json\n', j, '\n```') WHEN 2 THEN concat('Sure: ', j, ' Bye')
      ELSE substring(j, 1, length(j) - 5) END""").alias("text"))


def risky_inputs(conversations: DataFrame, phrases: tuple[str, ...]) -> DataFrame:
    """The texts of conversations, every fifth row of them with a phrase that asks for a forbidden tactic."""
    some = F.array(*[F.lit(p.upper() if i % 2 else p) for i, p in enumerate(phrases)])
    at = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(phrases))).cast("int")
    return conversations.withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.concat(
        "text", F.lit(" use "), F.get(some, at))).otherwise(F.col("text")))


def error_log(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", F.expr("""concat(CASE turn % 6
      WHEN 0 THEN '429 Too Many Requests: ' WHEN 1 THEN 'Model not found (404): '
      WHEN 2 THEN 'PERMISSION_DENIED on resource: ' WHEN 3 THEN 'Unable to authenticate: '
      WHEN 4 THEN 'iam.serviceAccounts.getAccessToken denied: ' ELSE 'ECONNRESET by peer: ' END,
      text)""").alias("message"))


def pasted_inputs(pages: DataFrame) -> DataFrame:
    """Pasted inputs around page URLs: a keyword line, the page, a sitemap and two competitors."""
    return pages.select(F.col("page_id").alias("input_id"), F.expr("""concat(
      CASE WHEN page_id % 3 = 0 THEN concat('Keyword: topic ', page_id, '\n') ELSE '' END,
      'Please check ', url, ', then https://rival.example.org/a-', page_id, '.',
      CASE WHEN page_id % 2 = 0 THEN ' See https://maps.example.org/sitemap.xml!' ELSE '' END,
      ' and (https://second.example.net/b) now')""").alias("raw_input"))
