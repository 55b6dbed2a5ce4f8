"""Word lists, lookup tables, thresholds and text patterns that a result depends on.

They are data, not logic.  Every list is in its natural order and every operator that uses one
takes it as a parameter, so a caller can pass their own.
"""

# --- fixed values: page types -------------------------------------------------------------------
PAGE_TYPES = (
    "home", "product", "collection", "faq", "about", "contact",
    "blog", "policy", "podcast", "service", "category", "other",
)

# First match wins; checked against the lower-cased URL path.
PAGE_TYPE_PATTERNS = (
    ("product", r"/(products?|สินค้า|item)/"),
    ("category", r"/(collections?|category|หมวด|catalog|หมวดหมู่)/"),
    ("service", r"/(service|บริการ|solution)/"),
    ("faq", r"/(faq|คำถาม|help|ช่วยเหลือ)"),
    ("about", r"/(about|เกี่ยวกับ|ทีม|team)"),
    ("contact", r"/(contact|ติดต่อ)"),
    ("podcast", r"/(podcast|episode|ep)/"),
    ("blog", r"/(blog|news|article|บทความ|ข่าว|insight|learn)/"),
    ("policy", r"/(policy|term|privacy|return|refund|นโยบาย)"),
)

# Crawl priority by path; a path that matches none gets CRAWL_PRIORITY_BASE + its depth.
CRAWL_PRIORITY_PATTERNS = (
    (1, r"/(product|สินค้า|item)/"),
    (2, r"/(collection|category|หมวด|หมวดหมู่|catalog)/"),
    (3, r"/(service|บริการ|solution)/"),
    (4, r"/(about|contact|faq|เกี่ยวกับ|ติดต่อ|คำถาม)"),
    (5, r"/(blog|news|article|บทความ|insight)/"),
)
CRAWL_PRIORITY_BASE = 6
CRAWL_FRONTIER_CAP = 80

TOP_PAGE_WEIGHTS = {
    "home": 100, "category": 80, "collection": 78, "product": 70, "service": 65, "about": 60,
    "contact": 50, "blog": 40, "faq": 35, "podcast": 15,
}
TOP_PAGE_DEFAULT_WEIGHT = 10
CONTEXT_PAGE_ORDER = (
    "home", "service", "category", "collection", "product", "about",
    "contact", "faq", "blog", "podcast", "policy", "other",
)
VERIFIED_URL_ORDER = ("home", "service", "category", "product", "about", "blog", "other")

# --- fixed values: URL filters ------------------------------------------------------------------
SITEMAP_ASSET_PATTERN = r"(?i)\.(jpg|jpeg|png|gif|webp|svg|pdf|mp4|mp3|zip|woff|woff2|ttf)$"
CRAWL_ASSET_PATTERN = (
    r"(?i)\.(jpg|jpeg|png|gif|webp|svg|pdf|zip|xml|woff|woff2|ttf|eot|ico|map)$"
)
TRACKING_PATTERN = r"(?i)[?&](utm_|ref=|fbclid|gclid|source=)"
OTHER_PATH_FILE_PATTERN = (
    r"(?i)\.(xml|html|txt|pdf|jpg|jpeg|png|gif|svg|css|js|ico|webp|woff|woff2)$"
)
OTHER_PATH_SYSTEM_PATTERN = (
    r"^/(sitemap|robots|feed|rss|wp-|admin|login|cart|checkout|account|search|tag|author|page/[0-9])"
)
SITEMAP_CANDIDATE_PATHS = (
    "/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/wp-sitemap.xml",
    "/sitemap/sitemap.xml", "/sitemap/index.xml", "/sitemaps/sitemap.xml",
    "/page-sitemap.xml", "/post-sitemap.xml", "/sitemap.xml.gz",
)

# --- fixed values: stop words -------------------------------------------------------------------
# Words of two characters or more; one-character words can never become tokens.
STOP_WORDS_BY_LANGUAGE = {
    "en": (
        "the and for are was with this that from have has not but can will "
        "your all one more page home our you how get use new its their been "
        "also into than then when what who which where why about after before"
    ).split(),
    "th": (
        "ไม่ และ ของ ที่ ใน มี กับ การ เป็น ได้ ให้ คือ จาก ใช้ หรือ แบบ "
        "เว็บ ด้วย โดย แต่ ก็ ยัง จะ นั้น นี้ อยู่ มาก น้อย ทุก บาง เพื่อ "
        "ถ้า เมื่อ แล้ว อีก ทำ บน ล่าง ผ่าน ตาม ระหว่าง ก่อน หลัง ใต้ เหนือ"
    ).split(),
    "ja": "から まで より です ます".split(),
    "zh": "一个".split(),
    "ko": "으로 에서 하다 있다".split(),
    "es_pt": (
        "los las una unos para con que por del como más pero sin sobre entre "
        "os as um uma com do da mais mas sem"
    ).split(),
    "fr": "les des une pour avec que par sur dans mais ou si car aussi".split(),
    "de": "die der das und ist ein eine für mit auf von zu im als auch".split(),
}
STOP_WORDS = tuple(
    dict.fromkeys(w for words in STOP_WORDS_BY_LANGUAGE.values() for w in words)
)

# --- fixed values: article text -----------------------------------------------------------------
# (label shown as evidence, words that must follow each other in the lower-cased body text)
OVERCLAIMS = (
    ("การันตีวีซ่า", ("การันตีวีซ่า",)),
    ("ผ่านแน่นอน", ("ผ่านแน่นอน",)),
    ("100%", ("100%",)),
    ("ไม่มีพลาด", ("ไม่มีพลาด",)),
    ("guaranteevisa", ("guarantee", "visa")),
    ("100% success", ("100% success",)),
    ("definitely approved", ("definitely approved",)),
)
OFFICIAL_LINK_PATTERN = r"(?i)\.gov|\.go\.th|\.gouv|embassy|consulate|mfa\.|mofa\.|schengenvisainfo"
CTA_PHRASES = (
    "contact us", "get started", "book now", "apply now", "ติดต่อ", "สอบถาม", "จอง", "สมัคร",
)
# Words searched in lower-cased text.
ARTICLE_FAQ_WORDS = ("faq", "คำถาม", "ถามตอบ", "frequently asked")
LINE_WORDS = ("line", "ไลน์")
LINE_HANDLE_PATTERN = r"(?i)@[a-z0-9_]"
CONTACT_WORDS = ("+66", "@", "line.me", "facebook.com", "line id")
CONTACT_NUMBER_PATTERN = r"0[0-9]{8}"
WEAK_ANCHOR_PATTERN = r"(?i)click here|read more|here|link"
BROKEN_NAV_PATTERNS = (r"^[A-Z_]{3,}$", r"\{[^}]+\}", r"(?i)^(ITEM|VIDEO|BLOCK|NODE|VAR)_[0-9]+$")
BROKEN_NAV_ISSUE_PATTERNS = (r"^[A-Z_]{3,}$", r"(?i)^(ITEM|VIDEO|BLOCK|NODE)_[0-9]+")
RAW_VARIABLE_PATTERN = r"^[A-Z_]{3,}$"

# First type whose words occur in the lower-cased text wins.
ARTICLE_TYPE_WORDS = (
    ("Visa", ("visa", "วีซ่า", "embassy", "consulate", "schengen", "เอกสารยื่นวีซ่า", "ยื่นวีซ่า")),
    ("Travel", ("travel", "เที่ยว", "ท่องเที่ยว", "flight", "hotel", "itinerary", "ที่พัก",
                "สายการบิน")),
    ("Affiliate", ("review", "รีวิว", "ซื้อ", "ราคา", "product", "affiliate", "สินค้า", "แนะนำ",
                   "เปรียบเทียบ")),
    ("Local/Service", ("service", "contact", "phone", "line", "booking", "บริการ", "ติดต่อ", "โทร",
                       "จอง", "ราคาบริการ")),
)
ARTICLE_TYPE_UPGRADE_WORDS = (
    ("Visa", ("visa", "วีซ่า", "embassy", "schengen")),
    ("Travel", ("travel", "เที่ยว", "hotel", "flight")),
)
BLACK_HAT_WORDS = (
    "cloaking", "doorway page", "link spam", "fake click", "fake traffic", "hidden text",
    "keyword stuff", "scrape google", "bypass robots", "fake review",
)

# --- fixed values: competitors and markets ------------------------------------------------------
GENERIC_PLATFORMS = (
    "facebook.com", "www.facebook.com", "m.facebook.com",
    "youtube.com", "www.youtube.com", "m.youtube.com",
    "tiktok.com", "www.tiktok.com", "lemon8-app.com",
    "instagram.com", "www.instagram.com",
    "twitter.com", "x.com", "www.twitter.com",
    "linkedin.com", "www.linkedin.com",
    "pinterest.com", "www.pinterest.com",
    "reddit.com", "www.reddit.com",
    "line.me", "www.line.me",
    "wikipedia.org", "th.wikipedia.org", "en.wikipedia.org",
    "google.com", "google.co.th",
    "pantip.com", "sanook.com", "kapook.com", "wongnai.com", "bloggang.com",
    "thairath.co.th", "dailynews.co.th", "posttoday.com", "nationthai.net",
    "khaosod.co.th", "matichon.co.th", "prachachat.net", "bangkokpost.com",
    "manager.co.th", "springnews.co.th", "pptvhd36.com", "thaipbs.or.th",
    "trueid.net", "one31.net", "ch3thailand.com", "ch7.com",
    "go.th", "myhora.com", "ldd.go.th", "dbd.go.th", "rd.go.th",
    "shopee.co.th", "lazada.co.th", "amazon.com", "ebay.com",
)
GOVERNMENT_SUFFIX = ".go.th"
DOMAIN_PATTERN = r"(?:https?://)?(?:www\.)?([a-zA-Z0-9-]+\.[a-zA-Z]{2,}(?:\.[a-zA-Z]{2})?)"
GROUNDING_EXCLUDED = ("google", "facebook", "wikipedia")

# (rank, language prefix, location, language); the English market is also the default.
MARKETS = (
    (1, "th", "Thailand", "Thai"),
    (2, "en", "Thailand", "English"),
    (3, "ja", "Japan", "Japanese"),
    (4, "zh", "Taiwan", "Chinese Traditional"),
    (5, "ko", "South Korea", "Korean"),
)
DEFAULT_MARKET_PREFIX = "en"

# --- fixed values: costs ------------------------------------------------------------------------
# model, USD per million input tokens, USD per million output tokens
MODEL_PRICES = (
    ("gemini-3.5-flash", 0.15, 0.60),
    ("gemini-2.5-flash", 0.15, 0.60),
    ("gemini-2.5-pro", 1.25, 10.00),
)
DEFAULT_PRICE_MODEL = "gemini-2.5-pro"
ESTIMATED_OUTPUT_TOKENS = 4000
CHARS_PER_TOKEN = 4
THB_PER_USD = 34

# --- fixed values: model answers ----------------------------------------------------------------
ANSWER_REQUIRED_TEXT = ("salesPitchSummary", "executiveSummary", "businessType", "overallVerdict")
ANSWER_REQUIRED_LISTS = ("actionPlan",)
ANSWER_REQUIRED_PERIODS = ("day30", "day60", "day90")
ANSWER_OPTIONAL_LISTS = (
    "whatIsWorking", "contentGaps", "landingPages", "keywordSignals", "keywordSuggestions",
    "competitors", "detailedSitemap", "teamActions", "issueInsights", "seoOpportunity",
    "contentOpportunity", "uxInsights", "salesTalkingPoints", "businessInsights", "quickWins",
    "roleInsights",
)
# field, fewest, most
ARTICLE_ANSWER_BOUNDS = (
    ("topProblems", 3, 5), ("topFixes", 3, 5), ("rewriteBrief", 6, 12), ("titleOptions", 5, 7),
    ("metaOptions", 3, 5), ("h2Suggestions", 6, 10), ("faqSuggestions", 4, 8),
)
# First class whose words occur in the lower-cased message wins.
ERROR_CLASSES = (
    ("impersonation_denied", ("iam.serviceaccounts.getaccesstoken", "generateaccesstoken")),
    ("authentication_failed", ("unable to authenticate", "googleautherror")),
    ("permission_denied", ("permission", "aiplatform.endpoints.predict", "permission_denied")),
    ("model_missing", ("not found", "not exist", "404")),
    ("quota", ("quota", "429")),
)
RETRYABLE_ERROR_WORDS = (
    "429", "503", "overloaded", "quota", "fetch failed", "econnreset", "etimedout", "network",
    "socket", "404", "not found", "not supported", "not exist",
)

# --- fixed values: issue levels -----------------------------------------------------------------
PRIORITIES = ("critical", "high", "medium", "low")
IMPACT_VERY_HIGH, IMPACT_HIGH, IMPACT_MEDIUM_HIGH, IMPACT_MEDIUM, IMPACT_LOW = (
    "สูงมาก", "สูง", "กลาง-สูง", "กลาง", "ต่ำ",
)

# --- fixed values: article verdicts -------------------------------------------------------------
VERDICTS = (
    (97, "Apex Weapon"), (93, "Unfair Advantage"), (88, "Page-One Contender"),
    (80, "Strong but Beatable"), (70, "Needs Strategic Upgrade"), (60, "Vulnerable"),
    (40, "Competitors Are Winning"),
)
LOWEST_VERDICT = "Rewrite / Merge / Noindex Candidate"

# --- fixed values: article score categories -----------------------------------------------------
# key, name, maximum, (excellent, good, warning) cut-offs, difficulty, priority, confidence
SCORE_CATEGORIES = (
    ("crawl", "Crawl & Index Clarity", 7, (6, 4, 2), "easy", 1, 85),
    ("technical", "Technical SEO Foundation", 7, (6, 4, 2), "medium", 2, 80),
    ("intent", "Search Intent Match", 12, (10, 7, 4), "medium", 1, 75),
    ("depth", "Content Depth & Usefulness", 12, (10, 7, 4), "hard", 2, 80),
    ("competitors", "Competitor Defense", 10, (8, 6, 4), "hard", 3, 70),
    ("trust", "E-E-A-T / Trust / Source Quality", 12, (10, 7, 4), "medium", 2, 80),
    ("internal_links", "Internal Link Power", 9, (7, 5, 3), "easy", 3, 75),
    ("snippet", "CTR / SERP Snippet Power", 6, (5, 3, 2), "easy", 2, 85),
    ("extractability", "AI Search Extractability", 8, (7, 5, 3), "medium", 2, 70),
    ("freshness", "Freshness / Decay Risk", 5, (4, 3, 2), "easy", 3, 70),
    ("conversion", "Conversion Path Quality", 5, (4, 3, 2), "medium", 3, 65),
    ("cannibalization", "Cannibalization Risk Control", 5, None, "medium", 4, 40),
    ("topical", "Topical Authority Fit", 2, None, "hard", 5, 30),
)
CONSTANT_SCORES = {"cannibalization": (5, "good", "needs_sitemap"), "topical": (1, "warning", "needs_site_analysis")}
SCORE_WITHOUT_COMPETITORS = 5

# --- fixed values: article failure rules --------------------------------------------------------
# key, type, confidence, impact, effort, priority
FAILURE_RULES = (
    ("title", "Missing Title Tag", 99, "high", "easy", 1),
    ("h1", "Missing H1", 99, "high", "easy", 1),
    ("thin", "Thin Content", 90, "high", "hard", 2),
    ("faq", "No FAQ Section", 85, "medium", "medium", 2),
    ("links", "No Internal Links", 95, "medium", "easy", 2),
    ("author", "Missing Author / E-E-A-T Signal", 80, "medium", "easy", 3),
    ("date", "No Publication/Update Date", 75, "medium", "easy", 3),
    ("sources", "No Official Sources for Visa/Travel", 90, "high", "medium", 1),
    ("overclaim", "Compliance Risk: Overclaim Language", 95, "high", "easy", 1),
    ("meta", "Missing Meta Description", 99, "medium", "easy", 2),
    ("keyword", "Keyword Missing from Title", 80, "high", "easy", 1),
    ("tables", "No Tables in Visa/Travel Content", 85, "medium", "medium", 2),
    ("structure", "Poor Content Structure", 90, "medium", "medium", 2),
    ("competitor_faq", "Competitor FAQ Gap", 85, "high", "medium", 1),
    ("competitor_depth", "Content Depth Far Below Competitors", 85, "high", "hard", 1),
)
