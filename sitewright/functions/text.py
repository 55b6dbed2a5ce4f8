"""Text expressions: white space, tags, entities, tokens.  Everything here is a Column expression."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character the audited pages' own scripting language treats as white space.
_WS_POINTS = (
    9, 10, 11, 12, 13, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)
WS_CHARS = "".join(map(chr, _WS_POINTS))
WS = f"[{WS_CHARS}]"
# The same set without the plain space; the outer range rejects ASCII at the first test.
_WS_NOT_SPACE = "[\\t-\\r]|[\\u00a0-\\ufeff&&[" + WS_CHARS.replace(" ", "") + "]]"

# Attribute part of a tag: a `>` inside a quoted value does not end the tag.  Possessive
# quantifiers keep the match linear and free of recursion on hostile or truncated markup.
TAG_BODY = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+"""
ANY_TAG = rf"<[a-zA-Z/!?]{TAG_BODY}(?:>|\z)"

_NAMED = {f"&{n};": chr(cp) for n, cp in name2codepoint.items() if n != "amp"}
_NAMED |= {"&apos;": "'"} | {f"&{n}": chr(name2codepoint[n]) for n in ("lt", "gt", "quot", "nbsp")}

_NAMED_JSON = json.dumps(_NAMED).replace("'", "\\u0027")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    spaced = F.regexp_replace(c, _WS_NOT_SPACE, " ")
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def words(c: Column) -> Column:
    """Non-empty white-space separated tokens of already collapsed text."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def count_words(c: Column, shortest: int = 1) -> Column:
    """How many tokens of collapsed text have at least `shortest` characters."""
    return F.regexp_count(c, F.lit("[^ ]{%d,}" % shortest))


def null_if_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def apply_sql(lambda_sql: str, c: Column) -> Column:
    """A one-argument SQL lambda applied to `c`.

    Written as SQL text because these building blocks occur dozens of times in one plan, and a
    text costs one call to the JVM where the same tree of Column objects costs hundreds.
    """
    return F.get(F.call_function("transform", F.array(c), F.expr(lambda_sql)), F.lit(0))


DECODE_SQL = f"""
x -> CASE WHEN contains(x, '&') THEN replace(replace(
  get(transform(
    array(aggregate(
      sort_array(filter(
        array_distinct(regexp_extract_all(x, r'&(?:[A-Za-z][A-Za-z0-9]{{1,31}};|lt|gt|quot|nbsp)', 0)),
        e -> e <> '&amp;'), false),
      x,
      (acc, e) -> replace(
        acc, e, coalesce(try_element_at(from_json(r'{_NAMED_JSON}', 'map<string,string>'), e), e)))),
    y -> CASE WHEN contains(y, '&#') THEN aggregate(
      sort_array(array_distinct(
        regexp_extract_all(y, r'&#(?:[0-9]{{1,7}}|[xX][0-9a-fA-F]{{1,6}});?', 0)), false),
      y,
      (acc, e) -> replace(acc, e, get(transform(
        array(cast(CASE WHEN lower(e) LIKE '&#x%'
                        THEN conv(regexp_replace(e, '[&#;xX]', ''), 16, 10)
                        ELSE regexp_replace(e, '[&#;]', '') END AS bigint)),
        cp -> CASE WHEN cp BETWEEN 1 AND 1114111 AND NOT cp BETWEEN 55296 AND 57343
                   THEN decode(unhex(lpad(hex(cp), 8, '0')), 'UTF-32') ELSE '\ufffd' END), 0)))
      ELSE y END), 0),
  '&amp;', '&'), '&amp', '&') ELSE x END
"""


def decode_entities(c: Column) -> Column:
    """Character references to characters: named ones, then numeric ones, then ampersands.

    `&amp;` comes last so that it is decoded once only.
    """
    return apply_sql(DECODE_SQL, c)


def strip_tags(c: Column) -> Column:
    """Tags removed without a separator, so text on both sides of a tag joins up."""
    return F.regexp_replace(c, ANY_TAG, "")


def markup_text(c: Column) -> Column:
    """Collapsed text of a piece of markup."""
    return collapse_ws(decode_entities(strip_tags(c)))


def any_rlike(c: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def contains_any(c: Column, words) -> Column:
    """Any of the words occurs in `c`.  A byte search per word beats an alternation pattern."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def first_case(cases, otherwise) -> Column:
    """Ordered (label, condition) list: label of the first condition that holds."""
    out = None
    for label, cond in cases:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(otherwise)


def keep(cond: Column, value) -> Column:
    """`value` when `cond` holds, else null; for use inside `compact`."""
    return F.when(cond, value if isinstance(value, Column) else F.lit(value))


def compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def escape_html(c: Column) -> Column:
    """Text that can stand inside markup."""
    out = F.coalesce(c, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out
