"""Personal data: patterns propose spans, checksums and bounds confirm them, nearby words adjust the score.

Only built-in expressions are used.  A span is (kind, start, end, score) with code-point offsets, end exclusive.
All kinds are kept whatever their score; iban, the kind added here, has passed its checksum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each kind looks like.  The guards and possessive quantifiers change no match; they keep the
# search linear where a run of characters is long.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Account numbers end after the length of their country, so that a capital or digit after a space isn't taken in; of
# countries without a known length, runs or groups of four are tried.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(" ".join(IBAN_LENGTHS.values()).split())
IBAN = (r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:"
        + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
        + rf"|(?!{_KNOWN})[A-Z0-9]{{4}}(?:[A-Z0-9]{{11,30}}|(?:\x20[A-Z0-9]{{4}}){{2,7}}(?:\x20[A-Z0-9]{{1,3}})?))(?![A-Za-z0-9])")
KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
CONTEXT_CHARS = 40
SUPPORT = {
    "email": "(?i)mail|contact|write|kontakt|correo|courriel",
    "ip": "(?i)ip|host|server|address|login|adresse",
    "card": "(?i)card|visa|credit|pay|karte|carte|tarjeta",
    "phone": "(?i)phone|tel|call|mobile|fax|anruf|appel",
    "iban": "(?i)iban|account|bank|transfer|konto|compte|cuenta",
}
AGAINST = r"(?i)\b(?:versions?|isbn|orders?|invoices?|serial|examples?|samples?|tests?)\b"
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.7}
SPAN = "struct<kind:string,start:int,end:int,score:double>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of the value pass the Luhn check."""
    d = F.reverse(_digits(value))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(d, i, F.lit(1)).cast("int") + 1)))
    return F.when(F.length(d) > 0, total % 10 == 0).otherwise(F.lit(False))


def mod97(value: Column) -> Column:
    """Whether the value, without spaces, passes the mod-97 check of account numbers."""
    v = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))
    code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)), F.lit(0),
        lambda acc, i: F.when(code(i) <= 57, (acc * 10 + code(i) - 48) % 97).otherwise((acc * 100 + code(i) - 55) % 97))
    return F.when(F.length(v).between(15, 34), rest == 1).otherwise(F.lit(False))


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (F.when(F.length(bare) <= 3, bare.cast("int")).otherwise(256) <= 255)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _small),
    "card": lambda v: F.length(_digits(v)).between(13, 19) & luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "iban": mod97,
}
PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN}
# A cheap test that every text with a match passes.
GATE = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.contains(t, F.lit(".")),
    "card": lambda t: F.lit(True),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: F.lit(True),
}


def _matches(text: Column, kind: str) -> Column:
    """All matches of a kind as (start, end, value, before): the gaps between matches give their places."""
    found = F.regexp_extract_all(text, F.lit(PATTERN[kind]), F.lit(0))
    gaps = F.split(text, PATTERN[kind], -1)
    return found, gaps


def _spans(found: Column, gaps: Column, kind: str) -> Column:
    steps = F.arrays_zip(found.alias("v"), F.slice(gaps, 1, F.size(found)).alias("g"))
    placed = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,v:string,b:string>>)").alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + F.length(s["g"]) + F.length(s["v"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(s["g"])).alias("start"),
                (acc["at"] + F.length(s["g"]) + F.length(s["v"])).alias("end"),
                s["v"].alias("v"), F.right(s["g"], F.lit(CONTEXT_CHARS)).alias("b")))).alias("out")),
    )["out"]
    score = lambda s: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(PRIOR[kind])
                      + F.when(s["b"].rlike(SUPPORT[kind]), 0.2).otherwise(0.0)
                      - F.when(s["b"].rlike(AGAINST), 0.3).otherwise(0.0))), 3)
    kept = F.filter(placed, lambda s: VALID[kind](s["v"]))
    return F.transform(kept, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score(s).alias("score")))


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with `out`: array of spans, by kind in the order of KINDS, then by start.

    Whole texts are searched; a null text counts as empty and has no spans; a column named `out` is replaced.
    Matches of different kinds may overlap; matches of one kind don't.  Rows, ties and repeats stay as they are.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    work = docs.drop(out)
    names = work.columns
    found, gaps, spans = {}, {}, {}
    for kind in KINDS:
        f, g = _matches(t, kind)
        found[f"_found_{kind}"] = F.when(GATE[kind](t), f)
        gaps[f"_gaps_{kind}"] = F.when(F.size(F.col(f"_found_{kind}")) > 0, g)
        spans[f"_spans_{kind}"] = F.when(F.size(F.col(f"_found_{kind}")) > 0, _spans(F.col(f"_found_{kind}"), F.col(f"_gaps_{kind}"), kind)).otherwise(empty)
    work = work.withColumns(found).withColumns(gaps).withColumns(spans)
    return work.select(*names, F.concat(*[F.col(s) for s in spans]).alias(out))


def redact(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; overlapping spans become one.

    The first span names the replacement.  Texts without spans, null ones included, stay as they are.
    """
    t, s = F.col(text), F.col(spans)
    ordered = F.sort_array(F.transform(s, lambda x: F.struct(x["start"].alias("a"), x["end"].alias("b"), x["kind"].alias("k"))))
    merged = F.aggregate(
        ordered, F.expr("cast(array() as array<struct<a:int,b:int,k:string>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["a"] < F.try_element_at(acc, F.lit(-1))["b"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.try_element_at(acc, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(acc, F.lit(-1))["b"], x["b"]).alias("b"),
                F.try_element_at(acc, F.lit(-1))["k"].alias("k")))),
        ).otherwise(F.concat(acc, F.array(x))))
    work = docs.withColumn("_merged", F.when(F.size(s) > 0, merged))
    m = F.col("_merged")
    pieces = F.transform(m, lambda x, i: F.concat(
        F.substring(t, F.when(i == 0, 1).otherwise(F.try_element_at(m, i)["b"] + 1),
                    x["a"] - F.when(i == 0, 0).otherwise(F.try_element_at(m, i)["b"])),
        F.lit("<"), x["k"], F.lit(">")))
    whole = F.concat(F.array_join(pieces, ""), F.substring(t, F.try_element_at(m, F.lit(-1))["b"] + 1, F.length(t)))
    return work.withColumn(text, F.when(m.isNotNull(), whole).otherwise(t)).drop("_merged")
