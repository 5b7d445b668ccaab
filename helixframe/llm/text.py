"""Vectorised word splitting and hashing over Arrow string columns.

A batch is cut into pieces of a few megabytes, so that the working arrays of a
task stay small however long the texts are; one very long text is a piece of
its own.  Nulls read as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20
#: Byte ranges hashed at once.
SPANS = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

_CODES = np.arange(256)
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
SAME = _CODES.astype(np.uint8)
#: True for bytes of words that end at a space or at \t \n \v \f \r.
SPACED = ~((_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13)))
#: True for bytes of words of ASCII digits, lower-case ASCII letters and all other characters above ASCII.
ALNUM = ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (the one of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: np.uint64, key: str) -> np.ndarray:
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE_BYTES), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= PIECE_BYTES:
            _POWERS[key] = have
    return have[:n]


@dataclass
class Words:
    """Words of some texts: byte ranges [starts, ends) of data, those of text i at [ptr[i], ptr[i+1])."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges: equal bytes, equal hash, wherever they stand.

    Ranges come by start.  They are hashed some at a time, so that working
    arrays stay small.
    """
    out = np.zeros(len(starts), dtype=np.uint64)
    for i in range(0, len(starts), SPANS):
        a, b = starts[i : i + SPANS], ends[i : i + SPANS]
        low, high = int(a[0]), int(b.max())
        n = high - low
        if n <= 0:
            continue
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * _powers(n, _BASE, "up"), out=total[1:])
        h = (total[b - low] - total[a - low]) * _powers(n, _INVERSE, "down")[np.minimum(a - low, n - 1)]
        out[i : i + SPANS] = h + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins and the last ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = LOWER, inside: np.ndarray = SPACED) -> Words:
    """table maps bytes first (lower case); inside tells the bytes of words."""
    data = table[data]
    n = len(data)
    is_word = inside[data]
    before = np.zeros(n, dtype=bool)
    after = np.zeros(n, dtype=bool)
    before[1:] = is_word[:-1]
    after[:-1] = is_word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of the batch with about size bytes of text each: (rows, bytes, offsets)."""
    data, offsets = flat(batch.column(batch.schema.get_field_index(column)))
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (the caller drops those that cross texts)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[i : len(h) - k + 1 + i] + np.uint64(i))
    return out


def inside_text(words: Words, k: int) -> np.ndarray:
    """Positions of words at which a run of k words of the same text starts."""
    n = int(words.ptr[-1])
    ok = np.zeros(n + 1, np.int32)
    full = words.counts >= k
    np.add.at(ok, words.ptr[:-1][full], 1)
    np.add.at(ok, words.ptr[1:][full] - (k - 1), -1)
    return np.flatnonzero(np.cumsum(ok)[:n] > 0)
