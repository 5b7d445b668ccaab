"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

All of it is built-in functions.  Base kinds (email, ip, card, phone) are kept
whatever their score; further kinds (iban, ssn) count from a score of 0.5 on.
Patterns are written so that a long run of letters or digits is read once
(possessive quantifiers, and no start within a run).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.spans import add_matches, count_of, hold, joined, located

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Words before a span that speak for its kind, and by how much; they raise a span's score from the checksum's.
CONTEXT = {
    "email": (r"(?i)\b(?:e-?mail|contact|write)\b", 0.3),
    "ip": (r"(?i)\b(?:ip|host|server|address)\b", 0.3),
    "card": (r"(?i)\b(?:card|visa|mastercard|credit|payment)\b", 0.3),
    "phone": (r"(?i)\b(?:phone|tel|call|mobile|fax)\b", 0.3),
    "iban": (r"(?i)\b(?:iban|bank|account|konto)\b", 0.3),
    "ssn": (r"(?i)\b(?:ssn|social security|tax id)\b", 0.3),
}
#: Score of a confirmed span without context.
PRIOR = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7, "ssn": 0.3}
NEEDED = 0.5
#: Code points before a span in which context words count.
NEAR = 40
#: Code points of the pieces they are looked up in.
PIECE = 1000


def luhn(match: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, digit(digits, i)).otherwise(F.when(digit(digits, i) > 4, digit(digits, i) * 2 - 9).otherwise(digit(digits, i) * 2)),
    )
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def digit(digits: Column, i: Column) -> Column:
    return F.ascii(F.substring(digits, i, F.lit(1))) - 48


def mod97(match: Column) -> Column:
    """The check of account numbers: the first four signs go last, letters count 10 to 35, the rest by 97 is 1."""
    turned = F.concat(F.substring(match, 5, 64), F.substring(match, 1, 4))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)),
        F.lit(0),
        lambda acc, i: F.when(code(turned, i) < 58, (acc * 10 + code(turned, i) - 48) % 97).otherwise((acc * 100 + code(turned, i) - 55) % 97),
    )
    return rest == 1


def code(text: Column, i: Column) -> Column:
    return F.ascii(F.substring(text, i, F.lit(1)))


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "ssn":
        return ~match.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def find_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All columns of docs, with pii_spans: array of (kind, start, end, score), base kinds first as listed, by start within a kind.

    Positions are code points, end exclusive.  A null text reads as empty and
    has no spans.  Matches of one kind don't overlap; those of several may.
    Rows are handled one by one: repeated rows give repeated results, an empty
    table an empty one.  A column of docs called pii_spans is replaced; other
    names are free.
    """
    old = [c for c in docs.columns if c != "pii_spans"]
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in old]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    text = F.col("__text")
    hints = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.contains("."), "ssn": text.contains("-")}
    work = add_matches(work, PATTERNS, "__text", hints)
    for kind in (*BASE, *MORE):
        work = work.withColumn(f"__s_{kind}", located(kind, PATTERNS[kind], "__text", lambda m, kind=kind: confirmed(kind, m)))

    def scored(kind: str) -> Column:
        words, gain = CONTEXT[kind]
        # Of pieces of the text, since to find a place in a string takes as long as the place is far.
        pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE + NEAR)))
        first = lambda s: F.greatest(s["start"] - NEAR, F.lit(0))
        near = lambda s, of: F.substring(F.element_at(of, F.floor(first(s) / PIECE).cast("int") + 1), first(s) % PIECE + 1, F.least(s["start"], F.lit(NEAR)))
        rated = lambda s, of: F.struct(s["kind"], s["start"], s["end"], (F.lit(PRIOR[kind]) + F.when(near(s, of).rlike(words), F.lit(gain)).otherwise(F.lit(0.0))).alias("score"))
        found = F.col(f"__s_{kind}")
        none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")
        out = F.when(F.size(found) > 0, hold(pieces, lambda of: F.transform(found, lambda s: rated(s, of)))).otherwise(none)
        return out if kind in BASE else F.filter(out, lambda s: s["score"] >= NEEDED)

    return work.select("row", F.concat(*[scored(kind) for kind in (*BASE, *MORE)]).alias("pii_spans")).select("row.*", "pii_spans")


def op5_pii_spans(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs).select("doc_id", "pii_spans")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE))
    counts = [count_of("pii_spans", kind).alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))
