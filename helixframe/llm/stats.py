"""Statistics of texts, for many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from helixframe.llm import text as tx

#: The signs that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LOWER = (_CODES >= 97) & (_CODES <= 122)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_FIRST = (_CODES & 0xC0) != 0x80

FEATURES = ("log_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "digit_share", "distinct_share", "line_share")


@dataclass
class Stats:
    words: tx.Words
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    n_lines: np.ndarray
    features: np.ndarray


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(mask, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs more than once; whether it is not its first occurrence."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1 if len(s) else np.zeros(0, bool)
    out_many, out_later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    out_many[order], out_later[order] = many, ~new
    return out_many, out_later


def measure(data: np.ndarray, offsets: np.ndarray) -> Stats:
    """All statistics of the texts; a text without words has zeros."""
    words = tx.split(data, offsets, tx.SAME, tx.SPACED)
    n, n_words, doc = len(offsets) - 1, words.counts, words.doc
    salt = tx.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    h = words.hashes()
    chars = _per_text(tx.SPACED[data] & _FIRST[data], offsets)
    symbols = _per_text(_SYMBOL[data], offsets)

    at = tx.inside_text(words, 3)
    many, _ = _repeated(tx.window_hashes(h, 3)[at] ^ salt[doc[at]] if len(at) else np.zeros(0, np.uint64))
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, at[many], 1)
    np.add.at(change, at[many] + 3, -1)
    repeats = np.bincount(doc[np.cumsum(change)[:-1] > 0], minlength=n)
    _, later = _repeated(h ^ salt[doc] if len(h) else h)
    distinct = n_words - np.bincount(doc[later], minlength=n)

    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, words.starts)
    first = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])]) if len(line) else np.zeros(0, np.int64)
    edges = np.r_[-1, breaks, len(data)]
    begin, end = np.maximum(offsets[doc[first]], edges[line[first]] + 1), np.minimum(offsets[doc[first] + 1], edges[line[first] + 1])
    _, later = _repeated(tx.span_hashes(data, begin, end) ^ salt[doc[first]] if len(first) else np.zeros(0, np.uint64))
    dup_lines = np.bincount(doc[first][later], minlength=n)
    lines = np.bincount(doc[first], minlength=n)

    some = np.maximum(n_words, 1)
    upper, lower = _per_text(_UPPER[data], offsets), _per_text(_LOWER[data], offsets)
    features = np.stack(
        [
            np.log1p(n_words), chars / some, symbols / some, dup_lines / np.maximum(lines, 1), repeats / some, upper / np.maximum(upper + lower, 1),
            _per_text(data == 33, offsets) / some, _per_text(_DIGIT[data], offsets) / np.maximum(chars, 1), distinct / some, lines / some,
        ],
        axis=1,
    )
    return Stats(words, n_words, chars, symbols, dup_lines, repeats, lines, features)
