"""URL expressions.  Everything works on absolute URLs and gives null for text that is not one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright import fixed_values as fv
from sitewright.functions.text import first_case, let, null_if_blank

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@\\\s]*@)?([^/:?#\\\s]+)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#\\\s]+(/[^?#]*)"
_ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#\\\s]+)"


def host(url: Column) -> Column:
    return null_if_blank(F.lower(F.regexp_extract(url, _HOST, 1)))


def bare_host(h: Column) -> Column:
    return F.regexp_replace(h, r"^www\.", "")


def site(url: Column) -> Column:
    """Host in lower case without `www.`; the key of everything that is per site."""
    return bare_host(host(url))


def scheme(url: Column) -> Column:
    return null_if_blank(F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://", 1)))


def origin(url: Column) -> Column:
    return null_if_blank(F.regexp_extract(url, _ORIGIN, 1))


def path(url: Column) -> Column:
    """Path of an absolute URL, `/` when it has none; null when the text is no absolute URL."""
    p = F.regexp_extract(url, _PATH, 1)
    return F.when(host(url).isNotNull(), F.when(p == "", F.lit("/")).otherwise(p))


def segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda s: s != "")


def depth(p: Column) -> Column:
    return F.size(segments(p))


def page_type(url: Column, *, strict: bool = False) -> Column:
    """One of the fixed page types.

    Matches on the path.  `strict=True` matches on the whole URL, so that a host such as
    `about.example` decides the type, which is the literal behaviour of the audited rules.
    """
    subject = F.lower(url if strict else path(url))
    home = F.when(path(url) == "/", F.lit("home")).otherwise(F.lit("other"))
    cases = [(name, subject.rlike(pattern)) for name, pattern in fv.PAGE_TYPE_PATTERNS]
    return F.coalesce(first_case(cases, home), F.lit("other"))


def crawl_priority(url: Column) -> Column:
    p = F.lower(path(url))
    out = F.when(p.isNull(), F.lit(99)).when(p == "/", F.lit(0))
    for rank, pattern in fv.CRAWL_PRIORITY_PATTERNS:
        out = out.when(p.rlike(pattern), F.lit(rank))
    return out.otherwise(fv.CRAWL_PRIORITY_BASE + depth(p))


def directory_pattern(p: Column) -> Column:
    """First two directories of a path: `/blog/2024/...`; null for the root."""
    segs = segments(p)
    n = F.size(segs)
    head = F.slice(segs, F.lit(1), F.least(F.lit(2), F.greatest(n - 1, F.lit(0))))
    out = F.concat(F.lit("/"), F.array_join(head, "/"), F.when(n > 1, "/...").otherwise(""))
    return F.when(n > 0, out)


def same_site_host(a: Column, b: Column) -> Column:
    """Equal hosts, or equal up to a leading `www.` on either side."""
    www = F.lit("www.")
    return (a == b) | (a == F.concat(www, b)) | (b == F.concat(www, a))


_UNSAFE_IN_PATH = r"""[^!-~]|["<>`{}]"""


def percent_encode(c: Column) -> Column:
    """Non-ASCII and unsafe characters of a URL as %XX; already safe text passes through."""
    def encode(text: Column) -> Column:
        coded = F.transform(
            F.split(text, ""),
            lambda ch: F.when(
                ch.rlike(_UNSAFE_IN_PATH), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))
            ).otherwise(ch),
        )
        return F.when(text.rlike(_UNSAFE_IN_PATH), F.array_join(coded, "")).otherwise(text)

    return let(c, encode)


def _without_dots(p: Column) -> Column:
    """`.` and `..` steps of a path resolved."""
    def clean(text: Column) -> Column:
        stack = F.aggregate(
            F.split(text, "/"),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(
                s == "..",
                F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc),
            )
            .otherwise(F.concat(acc, F.array(s))),
        )
        end = F.when(text.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
        return F.when(
            text.contains("/."), F.concat(F.array_join(stack, "/"), end)
        ).otherwise(text)

    return let(p, clean)


def base_parts(base: Column) -> Column:
    """The parts of a page URL that `resolve` needs, as a struct to compute once per page."""
    p = path(base)
    return F.struct(
        scheme(base).alias("scheme"),
        F.concat(
            scheme(base), F.lit("://"), F.lower(F.regexp_extract(base, r"://([^/?#\s]+)", 1))
        ).alias("origin"),
        p.alias("path"),
        F.regexp_extract(p, r"^(.*/)", 1).alias("folder"),
        F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1).alias("query"),
        host(base).alias("host"),
    )


def resolve(href: Column, base: Column) -> Column:
    """`href` as seen from the page whose `base_parts` are given; null when it is no URL."""
    nothing = F.lit(None).cast("string")
    only_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    rooted = _without_dots(
        F.when(href.startswith("/"), only_path).otherwise(F.concat(base["folder"], only_path))
    )
    return (
        F.when(href.startswith("http"), F.when(host(href).isNotNull(), href).otherwise(nothing))
        .when(base["origin"].isNull(), nothing)
        .when(href.startswith("//"), F.concat(base["scheme"], F.lit(":"), percent_encode(href)))
        .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
        .when(href.startswith("?"), F.concat(base["origin"], base["path"], percent_encode(href)))
        .when(
            href.startswith("#"),
            F.concat(base["origin"], base["path"], base["query"], percent_encode(href)),
        )
        .otherwise(F.concat(base["origin"], percent_encode(rooted), percent_encode(rest)))
    )


def clean_domain(c: Column) -> Column:
    """Domain as typed by a user: no scheme, no path, no trailing slash."""
    return F.regexp_replace(F.regexp_replace(c, r"^https?://", ""), r"/.*$", "")
