"""Whole-text statistics of many documents at once, in numpy over concatenated UTF-8 bytes.

Words are ``[^\\x20\\x09-\\x0D]+``.  Words, windows and lines are compared by 64-bit
polynomial hashes of their bytes over a table of random byte values.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_RNG = np.random.default_rng(20240611)
BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
LOWER = np.zeros(256, bool)
LOWER[ord("a") : ord("z") + 1] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0") : ord("9") + 1] = True
STOP = np.zeros(256, bool)
STOP[list(b".,;:?")] = True
CONT = (np.arange(256) & 0xC0) == 0x80

_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n, kept between calls."""
    if len(_POW[0]) < n:
        for k, b in enumerate((BASE, BASE_INV)):
            p = np.full(max(n, PIECE + 2), b, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that all bits depend on all."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Batch:
    """Concatenated documents with the parts that several operators need."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        self.b, self.offs, self.docs = data, offs, len(offs) - 1
        n = len(data)
        self.word = ~SPACE[data]
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:] = self.word[:-1]
            after[:-1] = self.word[1:]
        inner = offs[:-1][offs[:-1] < n]
        before[inner] = False
        after[inner[inner > 0] - 1] = False
        self.start = np.flatnonzero(self.word & ~before)
        self.end = np.flatnonzero(self.word & ~after) + 1
        self.first = np.searchsorted(self.start, offs)  # words before each document
        self.n_words = np.diff(self.first)
        self._prefix: np.ndarray | None = None

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            n = len(self.b)
            self._prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_VALUE[self.b] * powers(n)[0], out=self._prefix[1:])
        return self._prefix

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of the byte strings [lo, hi)."""
        p = self.prefix
        return mix((p[hi] - p[lo]) * powers(len(self.b) + 1)[1][lo] + (hi - lo).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.hash(self.start, self.end)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte value in each document."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.offs[1:]] - c[self.offs[:-1]]

    def per_doc_words(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-word value in each document."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.first[1:]] - c[self.first[:-1]]

    def doc_salt(self, counts: np.ndarray) -> np.ndarray:
        return np.repeat(mix(np.arange(1, self.docs + 1, dtype=np.uint64)), counts)

    def windows(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of ``n`` words inside a document."""
        if len(h) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(self.docs), self.n_words)
        at = np.flatnonzero(doc[: len(h) - n + 1] == doc[n - 1 :])
        w = np.zeros(len(at), np.uint64)
        for k in range(n):
            w = mix(w * BASE + h[at + k])
        return at, w

    def repeated_words(self, n: int = 3) -> np.ndarray:
        """Words of each document in ``n``-word windows that it holds twice or more."""
        h = self.words()
        at, w = self.windows(h, n)
        if not len(at):
            return np.zeros(self.docs, np.int64)
        w = w ^ mix(np.repeat(np.arange(1, self.docs + 1, dtype=np.uint64), self.n_words)[at])
        s = np.sort(w)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        mark = np.zeros(len(h), bool)
        if len(twice):
            k = np.minimum(np.searchsorted(twice, w), len(twice) - 1)
            hit = at[twice[k] == w]
            for i in range(n):
                mark[hit + i] = True
        return self.per_doc_words(mark)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, end) of the lines that hold a word."""
        nl = np.flatnonzero(self.b == 10)
        lo = np.concatenate([self.offs[:-1], nl + 1])
        lo.sort(kind="stable")
        doc = np.searchsorted(self.offs, lo, "right") - 1
        hi = np.concatenate([self.offs[1:], nl])
        hi.sort(kind="stable")
        doc = np.repeat(np.arange(self.docs), 1 + self.per_doc(self.b == 10)) if self.docs else doc
        c = np.searchsorted(self.start, hi) - np.searchsorted(self.start, lo)
        keep = c > 0
        return doc[keep], lo[keep], hi[keep]

    def dup_lines(self) -> np.ndarray:
        doc, lo, hi = self.lines()
        key = self.hash(lo, hi) ^ mix(doc.astype(np.uint64) + np.uint64(1))
        _, first = np.unique(key, return_index=True)
        once = np.bincount(doc[first], minlength=self.docs)
        return np.bincount(doc, minlength=self.docs) - once


def base_counts(x: Batch) -> dict[str, np.ndarray]:
    """The counts of the quality rules' contract."""
    return {
        "n_words": x.n_words,
        "word_chars": x.per_doc(x.word & ~CONT[x.b]),
        "n_symbols": x.per_doc(SYMBOL[x.b]),
        "n_dup_lines": x.dup_lines(),
        "n_repeat_words": x.repeated_words(),
    }


#: Names of the shape statistics, in order.
SHAPE = (
    "log_words", "mean_word", "upper", "digit", "symbol", "exclaim", "stop", "wide", "space", "distinct", "repeat", "dup_lines",
    "line_words", "odd_end", "short_words", "capital_words", "top_byte",
)


def shape(x: Batch) -> np.ndarray:
    """(documents, statistics) of scale-free statistics; all zero for a text without words."""
    base = base_counts(x)
    n = np.maximum(x.offs[1:] - x.offs[:-1], 1)
    words = np.maximum(x.n_words, 1)
    chars = np.maximum(x.per_doc(~CONT[x.b]), 1)
    h = x.words()
    key = np.sort(h ^ x.doc_salt(x.n_words))
    # distinct words: count first occurrences through a stable order of (document, word)
    order = np.argsort(h ^ x.doc_salt(x.n_words), kind="stable")
    doc = np.repeat(np.arange(x.docs), x.n_words)
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    distinct = np.bincount(doc[order[first]], minlength=x.docs) if len(key) else np.zeros(x.docs, np.int64)
    last = x.b[x.end - 1] if len(x.end) else x.b[:0]
    head = x.b[x.start] if len(x.start) else x.b[:0]
    alnum = UPPER | LOWER | DIGIT | (np.arange(256) >= 128) | STOP
    letters = np.maximum(x.per_doc(UPPER[x.b] | LOWER[x.b]), 1)
    line_doc, _, _ = x.lines()
    lines = np.maximum(np.bincount(line_doc, minlength=x.docs), 1)
    cols = [
        np.log1p(x.n_words), base["word_chars"] / words, x.per_doc(UPPER[x.b]) / letters, x.per_doc(DIGIT[x.b]) / chars, base["n_symbols"] / chars, x.per_doc(x.b == 33) / words,
        x.per_doc(STOP[x.b]) / words, x.per_doc(CONT[x.b]) / chars, x.per_doc(SPACE[x.b]) / n, distinct / words, base["n_repeat_words"] / words, base["n_dup_lines"] / lines,
        x.n_words / lines, x.per_doc_words(~alnum[last]) / words, x.per_doc_words((x.end - x.start) <= 3) / words, x.per_doc_words(UPPER[head]) / words, x.per_doc(x.b == 101) / letters,
    ]
    out = np.stack([np.asarray(c, np.float64) for c in cols], axis=1) if x.docs else np.zeros((0, len(SHAPE)))
    out[x.n_words == 0] = 0
    return out
