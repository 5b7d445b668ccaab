"""Spans of regular expressions with positions, by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_matches(df: DataFrame, patterns: dict[str, str], text: str, hint: dict[str, Column] | None = None) -> DataFrame:
    """Adds __m_<kind>: all leftmost non-overlapping matches; hint: what a text with a match surely fulfils."""
    hint = hint or {}
    for kind, pattern in patterns.items():
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        df = df.withColumn(f"__m_{kind}", F.when(hint[kind], found) if kind in hint else found)
    return df


#: Matches that are walked at once: adding to an array copies it.
WALK = 256


def located(kind: str, pattern: str, text: str, keep) -> Column:
    """Array of (start, end, kind) in code points, for those matches of __m_<kind> that keep(match) holds for.

    The text between the matches is what split() leaves; lengths of gaps and
    matches add up to positions: within WALK matches, then over those walks, so
    that a text of very many matches takes no quadratic time.
    """
    match = F.col(f"__m_{kind}")
    gaps = F.split(F.col(text), pattern, -1)
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string>>)")
    lengths = F.zip_with(match, F.slice(gaps, 1, F.size(match)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n")))
    span = lambda s, x: F.struct((s["at"] + x["g"]).alias("start"), (s["at"] + x["g"] + x["n"]).alias("end"), F.lit(kind).alias("kind"))
    walk = lambda some: F.aggregate(
        some,
        F.struct(F.lit(0).alias("at"), none.alias("all")),
        lambda s, x: F.struct((s["at"] + x["g"] + x["n"]).alias("at"), F.when(keep(x["m"]), F.concat(s["all"], F.array(span(s, x)))).otherwise(s["all"]).alias("all")),
    )
    moved = lambda w, at: F.transform(w["all"], lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["kind"].alias("kind")))
    starts = lambda walks: F.aggregate(walks, F.array(F.lit(0)), lambda all_, w: F.concat(all_, F.array(F.element_at(all_, -1) + w["at"])))
    many = hold(lengths, lambda every: hold(
        F.transform(F.sequence(F.lit(1), F.size(every), F.lit(WALK)), lambda i: walk(F.slice(every, i, F.lit(WALK)))),
        lambda walks: F.flatten(F.zip_with(walks, F.slice(starts(walks), 1, F.size(walks)), moved)),
    ))
    return F.when(F.size(match) > 0, many).otherwise(none)


def hold(column: Column, use) -> Column:
    """use(column), with the column computed once."""
    return F.element_at(F.transform(F.array(column), use), 1)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    """How many spans are of that kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
