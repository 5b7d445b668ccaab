"""Scalar functions of sequences: Column in, Column out, on plain strings of letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ACGT"
UNKNOWN = "N"
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}


def char_index(char: Column, alphabet: str = ALPHABET) -> Column:
    """Place of a letter in the alphabet; null for the unknown letter; any other letter raises."""
    at = F.instr(F.lit(alphabet), char)
    bad = F.raise_error(F.concat(F.lit("letter not in the alphabet: "), char))
    return F.when(char == UNKNOWN, F.lit(None).cast("int")).when(at > 0, (at - 1).cast("int")).otherwise(bad.cast("int"))


def validate(seq: Column, alphabet: str = ALPHABET, allow_n: bool = True) -> Column:
    """The sequence, or an error if it has letters that are neither in the alphabet nor, where allowed, N."""
    letters = alphabet + (UNKNOWN if allow_n else "")
    return F.when(seq.rlike(f"^[{letters}]*$") | seq.isNull(), seq).otherwise(F.raise_error(F.concat(F.lit("not a sequence over "), F.lit(letters), F.lit(": "), F.substring(seq, 1, 50))).cast("string"))


def reverse_complement(seq: Column, complement: dict[str, str] | None = None) -> Column:
    """The other strand, read backwards; N stays N."""
    pairs = complement or COMPLEMENT
    return F.reverse(F.translate(seq, "".join(pairs), "".join(pairs.values())))


def gc_content(seq: Column) -> Column:
    """Share of G and C among the letters other than N; 0 where there are none."""
    known = F.length(seq) - F.regexp_count(seq, F.lit("N"))
    return F.coalesce(F.regexp_count(seq, F.lit("[GC]")) / F.nullif(known, F.lit(0)), F.lit(0.0))


def char_share(seq: Column, chars: str) -> Column:
    """Share of some letters among all, N included; 0 for an empty sequence."""
    return F.coalesce(F.regexp_count(seq, F.lit(f"[{chars}]")) / F.nullif(F.length(seq), F.lit(0)), F.lit(0.0))


def entropy(probs: Column, eps: float = 1e-9) -> Column:
    """Shannon entropy in bits of an array of weights; 0 if they sum to 0."""
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    bits = F.aggregate(probs, F.lit(0.0), lambda a, x: a - x / total * F.log2(x / total + eps))
    return F.when(total == 0, F.lit(0.0)).otherwise(bits)


def information_content(probs: Column, size: int = 4, eps: float = 1e-9) -> Column:
    """log2 of the alphabet's size less the entropy; 0 for a column of zeros."""
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.log2(F.lit(float(size))) - entropy(probs, eps))


def consensus_letter(probs: Column, alphabet: str = ALPHABET) -> Column:
    """The first letter of greatest weight; N if all weights are 0."""
    best = F.array_position(probs, F.array_max(probs)).cast("int")
    return F.when(F.array_max(probs) == 0, F.lit(UNKNOWN)).otherwise(F.substring(F.lit(alphabet), best, F.lit(1)))


def insert(seq: Column, motif: Column | str, start: Column | int | None = None) -> Column:
    """motif spliced in before position start (the middle by default); the result is longer by the motif.

    Raises where start is negative or beyond the length less the motif's.
    """
    motif = F.lit(motif) if isinstance(motif, str) else motif
    at = F.floor(F.length(seq) / 2).cast("int") if start is None else F.lit(start) if isinstance(start, int) else start
    ok = (at >= 0) & (at <= F.length(seq) - F.length(motif))
    out = F.concat(F.substring(seq, F.lit(1), at), motif, F.substring(seq, at + 1, F.length(seq)))
    return F.when(ok, out).otherwise(F.raise_error(F.lit("insertion outside the sequence")).cast("string"))


def runs(motif: str) -> list[tuple[int, str]]:
    """Stretches of a motif without N, with their offsets."""
    out, i = [], 0
    while i < len(motif):
        j = i
        while j < len(motif) and (motif[j] == UNKNOWN) == (motif[i] == UNKNOWN):
            j += 1
        if motif[i] != UNKNOWN:
            out.append((i, motif[i:j]))
        i = j
    return out


def substitute(seq: Column, motif: str, start: Column | int | None = None) -> Column:
    """motif written over the sequence from start on (centred by default); N in the motif keeps what is there.

    Raises where the motif would not lie inside the sequence.
    """
    at = (F.floor(F.length(seq) / 2) - len(motif) // 2).cast("int") if start is None else F.lit(start) if isinstance(start, int) else start
    out = seq
    for offset, part in runs(motif):
        out = F.overlay(out, F.lit(part), at + offset + 1)
    ok = (at >= 0) & (at + len(motif) <= F.length(seq))
    return F.when(ok, out).otherwise(F.raise_error(F.lit("motif outside the sequence")).cast("string"))


def substitute_column(seq: Column, motif: Column, start: Column) -> Column:
    """As substitute, for a motif without N that is a column itself."""
    ok = (start >= 0) & (start + F.length(motif) <= F.length(seq))
    return F.when(ok, F.overlay(seq, motif, start + 1)).otherwise(F.raise_error(F.lit("motif outside the sequence")).cast("string"))


def multisubstitute(seq: Column, motifs: list[str], spacing: int | list[Column | int], start: Column | int | None = None) -> Column:
    """Motifs one after the other with gaps between them; by default the whole construct is centred."""
    gaps = [spacing] * (len(motifs) - 1) if isinstance(spacing, int) else list(spacing)
    if len(gaps) != len(motifs) - 1:
        raise ValueError("one gap fewer than motifs is needed")
    if any(isinstance(g, int) and g < 0 for g in gaps):
        raise ValueError("gaps must not be negative")
    total = F.lit(sum(map(len, motifs)))
    for g in gaps:
        total = total + g
    at = (F.floor(F.length(seq) / 2) - F.floor(total / 2)).cast("int") if start is None else F.lit(start) if isinstance(start, int) else start
    out = seq
    for i, motif in enumerate(motifs):
        out = substitute(out, motif, at)
        at = at + len(motif) + (gaps[i] if i < len(gaps) else 0)
    return out


def delete(seq: Column, start: Column | int, end: Column | int) -> Column:
    """The sequence without [start, end)."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    ok = (start >= 0) & (start < end) & (end <= F.length(seq))
    out = F.concat(F.substring(seq, F.lit(1), start), F.substring(seq, end + 1, F.length(seq)))
    return F.when(ok, out).otherwise(F.raise_error(F.lit("deletion outside the sequence")).cast("string"))


def permute(seq: Column, order: Column, start: Column | int) -> Column:
    """The stretch from start on in a given order (array of offsets in it), the rest as it is."""
    start = F.lit(start) if isinstance(start, int) else start
    middle = F.array_join(F.transform(order, lambda i: F.substring(seq, start + i + 1, F.lit(1))), "")
    return F.overlay(seq, middle, start + 1)


def hash_unit(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5: the same at any partitioning."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def draw_letter(unit: Column, probs: list[float] | None = None, alphabet: str = ALPHABET) -> Column:
    """The letter that a number in [0, 1) draws from a distribution (uniform by default)."""
    probs = probs or [1 / len(alphabet)] * len(alphabet)
    if len(probs) != len(alphabet) or abs(sum(probs) - 1) > 1e-6 or min(probs) < 0:
        raise ValueError("probabilities of all letters must sum to one")
    out, total = F.lit(alphabet[-1]), sum(probs)
    for letter, p in reversed(list(zip(alphabet[:-1], probs[:-1], strict=True))):
        total -= probs[alphabet.index(letter) + 1]
        out = F.when(unit < total, F.lit(letter)).otherwise(out)
    return out
