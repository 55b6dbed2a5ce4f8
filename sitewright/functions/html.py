"""Markup expressions on Spark SQL regular expressions and array functions.

There is no DOM on the JVM side.  Flat elements are read by pattern; an element that may nest is
read by `first_inner`, which counts open and close tags of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright.functions.text import TAG_BODY, decode_entities, let, null_if_blank, trim_ws

_JSON_LD = (
    r"(?is)<script([^>]*[\s\"'=]application/ld\+json[^>]*)>(.*?)</script\s*>"
)
_NOISE = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script(?:[\s/][^>]*)?>.*?(?:</script\s*>|\z)"
    r"|<style(?:[\s/][^>]*)?>.*?(?:</style\s*>|\z)"
    r"|<noscript(?:[\s/][^>]*)?>.*?(?:</noscript\s*>|\z)"
)
_SVG = r"|<svg(?:[\s/][^>]*)?>.*?(?:</svg\s*>|\z)"

# Tags whose start ends an open paragraph.
_PARAGRAPH_END = (
    r"(?is)^(.*?)(?:</?(?:p|address|article|aside|blockquote|body|center|details|dialog|dir|div|dl"
    r"|fieldset|figcaption|figure|footer|form|h[1-6]|header|hgroup|hr|html|main|menu|nav|ol|pre"
    r"|section|summary|table|td|th|tr|ul|li)[\s/>]|\z)"
)


def open_tag(name: str) -> str:
    return rf"(?i)<{name}(?:[\s/]{TAG_BODY})?+>"


def element(name: str) -> str:
    """Whole flat element; group 1 is its inner markup."""
    return rf"(?is)<{name}(?:[\s/]{TAG_BODY})?+>(.*?)</{name}\s*>"


def tag_with(attribute: str, *, value: str | None = None, part: str | None = None,
             token: str | None = None, name: str = "[a-z][a-z0-9]*") -> str:
    """Pattern of an opening tag whose attribute equals, contains, or has as one class, a word."""
    if part is not None:
        v = rf"""(?:"[^"]*{part}|'[^']*{part}|[^\s"'>]*{part})"""
    elif token is not None:
        v = (
            rf"""(?:"(?:[^"]*\s)?{token}(?:\s[^"]*)?"|'(?:[^']*\s)?{token}(?:\s[^']*)?'"""
            rf"""|{token}(?=[\s>/]))"""
        )
    else:
        v = rf"""(?:"{value}"|'{value}'|{value}(?=[\s>/]))"""
    return rf"(?i:<{name})(?=[\s/])[^>]*?[\s\"'/](?i:{attribute})\s*=\s*{v}"


def strip_noise(html: Column, *, svg: bool = True) -> Column:
    """Markup without comments, scripts, styles and the like; structured data stays as `x-jsonld`."""
    kept = F.regexp_replace(html, _JSON_LD, "<x-jsonld$1>$2</x-jsonld>")
    kept = F.when(html.contains("ld+json"), kept).otherwise(html)
    return F.regexp_replace(kept, _NOISE + (_SVG if svg else ""), "")


def bare_references_as_text(h: Column) -> Column:
    """Markup in which `&lt`, `&gt`, `&quot` and `&nbsp` without a semicolon stand for themselves, not for a character."""
    return F.regexp_replace(h, "&(?=(?:lt|gt|quot|nbsp)(?!;))", "&amp;")


def json_ld_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(_JSON_LD), F.lit(2))


def count_tags(h: Column, name: str) -> Column:
    return F.regexp_count(h, F.lit(rf"(?i)<{name}(?:[\s/]{TAG_BODY})?+>"))


def attr(tag: Column, name: str) -> Column:
    """Decoded value of an attribute of one tag, or of a string that starts after the tag name.

    Empty text when the attribute is absent or empty.
    """
    return decode_entities(F.call_function(
        "regexp_replace",
        F.regexp_extract(
            tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)""", 1),
        F.lit(r"""(?s)^(?:"([^"]*)"|'([^']*)'|(.*))$"""), F.lit("$1$2$3")))


def tag_text(h: Column) -> Column:
    """All opening tags of a page, one after the other, without the text between them."""
    return F.array_join(F.regexp_extract_all(h, F.lit(rf"<[a-zA-Z]{TAG_BODY}>"), F.lit(0)), "")


def tags(h: Column, name: str) -> Column:
    return F.regexp_extract_all(h, F.lit(rf"(?i)<{name}[\s/]{TAG_BODY}>"), F.lit(0))


def meta_content(metas: Column, key: str, value: str) -> Column:
    """Trimmed `content` of the first meta tag with `key`=`value`; null when absent or empty."""
    hit = F.filter(metas, lambda t: t.rlike(tag_with(key, value=value, name="meta")))
    return null_if_blank(trim_ws(attr(F.get(hit, F.lit(0)), "content")))


def inner_of(rest: Column, tag: Column) -> Column:
    """Inner markup of an element, given the markup after its open tag and its tag name.

    Open and close tags of the same name are counted; without a close tag the rest is taken.
    """
    pieces = F.split(rest, F.concat(F.lit(r"(?i)(?=</?"), tag, F.lit(r"[\s/>])")))
    size = F.length(tag)

    def step(acc: Column, piece: Column) -> Column:
        low = F.lower(F.left(piece, size + 2))
        delta = (
            F.when(low == F.concat(F.lit("</"), tag), -1)
            .when(low.startswith(F.concat(F.lit("<"), tag)), 1)
            .otherwise(0)
        )
        open_ = acc["open"] + delta
        return F.when(acc["open"] == 0, acc).otherwise(
            F.struct(
                open_.alias("open"),
                F.when(open_ == 0, acc["n"]).otherwise(acc["n"] + 1).alias("n"),
            )
        )

    start = F.struct(F.lit(1).alias("open"), F.lit(0).alias("n"))
    return let(
        pieces,
        lambda ps: F.array_join(
            F.slice(ps, F.lit(1), F.aggregate(ps, start, step, lambda a: a["n"])), ""
        ),
    )


def first_inner(h: Column, pattern: str) -> Column:
    """Inner markup of the first element whose open tag matches `pattern`; null without one.

    `pattern` must match from `<` and not consume the closing `>` of the tag.
    """
    full = rf"{pattern}[^>]*>"
    head = F.regexp_extract(h, full, 0)
    found = F.struct(
        F.get(F.split(h, full, 2), F.lit(1)).alias("rest"),
        F.lower(F.regexp_extract(head, r"^<([a-zA-Z][a-zA-Z0-9]*)", 1)).alias("tag"),
    )
    return let(
        found,
        lambda x: F.when(x["rest"].isNull(), F.lit(None).cast("string"))
        .when(x["tag"].isin("meta", "link", "img", "input", "br", "hr"), F.lit(""))
        .otherwise(inner_of(x["rest"], x["tag"])),
    )


def paragraphs(h: Column) -> Column:
    """Inner markup of every paragraph; the next block tag ends one that is not closed."""
    pieces = F.split(h, open_tag("p"))
    return F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces)),
        lambda x: F.regexp_extract(x, _PARAGRAPH_END, 1),
    )


def anchor_pieces(h: Column) -> Column:
    """For every `<a …>`: the markup from its attributes up to the next anchor."""
    pieces = F.split(h, r"(?i)<a(?=[\s/])")
    return F.slice(pieces, F.lit(2), F.size(pieces))


ANCHOR_HEAD = rf"^({TAG_BODY})>"
ANCHOR_TEXT = rf"(?is)^{TAG_BODY}>(.*?)(?:</a\s*>|\z)"


def anchor_text(piece: Column) -> Column:
    """Trimmed text of an anchor, given one of `anchor_pieces`."""
    inner = F.regexp_extract(piece, ANCHOR_TEXT, 1)
    return trim_ws(decode_entities(F.regexp_replace(inner, r"<[^>]*>", "")))


def body_markup(h: Column) -> Column:
    after = F.get(F.split(h, open_tag("body"), 2), F.lit(1))
    headless = F.regexp_replace(h, r"(?is)<head[\s>].*?</head\s*>|<title[\s>].*?</title\s*>", "")
    return F.coalesce(after, headless)
