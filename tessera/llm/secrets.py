"""Secret scans: fixed patterns plus sliding-window Shannon entropy per character class."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8

# Kinds in their order, and the base patterns.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# Allow-list: what looks random but is not secret.
ALLOWED = (
    re.compile(r"[0-9]+"),
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[-_T0-9]*"),
    re.compile(r"(?:[A-Za-z]+[-_/+=]+)*[A-Za-z]+[0-9]{0,4}"),
    re.compile(r"(?i)(?:example|sample|dummy|placeholder|your|test)[-_].*"),
    re.compile(r"(.{1,4})\1+.{0,3}"),
)


class Rules(NamedTuple):
    """Window length and the entropy in bits that a window of a class needs."""

    window: int = 20
    hex_bits: float = 2.8
    word_bits: float = 3.6
    base64_bits: float = 3.8


HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
WORD_ONLY = re.compile(r"[A-Za-z0-9]+")


def class_bits(candidate: str, rules: Rules) -> float:
    """The threshold of the narrowest character class that holds the candidate."""
    return rules.hex_bits if HEX_ONLY.fullmatch(candidate) else rules.word_bits if WORD_ONLY.fullmatch(candidate) else rules.base64_bits


def dense_windows(s: str, rules: Rules) -> list[tuple[int, int]]:
    """Merged spans of ``s`` whose windows reach the class's entropy and hold a digit and a letter.

    Each step drops one character and adds one: with the sum of c log2 c over the
    counts kept up to date, a window costs constant time.
    """
    w, need = rules.window, class_bits(s, rules)
    plogp = [0.0] + [c * math.log2(c) for c in range(1, w + 1)]
    counts: dict[str, int] = {}
    total, digits, out = 0.0, 0, []
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        total += plogp[c + 1] - plogp[c]
        counts[ch] = c + 1
        digits += "0" <= ch <= "9"
        if i >= w:
            old = s[i - w]
            c = counts[old]
            total += plogp[c - 1] - plogp[c]
            counts[old] = c - 1
            digits -= "0" <= old <= "9"
        if i >= w - 1 and 0 < digits < w and math.log2(w) - total / w >= need:
            if out and out[-1][1] >= i - w + 1:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i - w + 1, i + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed kinds, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def entropy_spans(text: str, base: list[tuple[int, int, int]], rules: Rules) -> list[tuple[int, int, int]]:
    """Dense windows of candidate strings that no allow-list pattern covers, without base spans.

    What base spans leave of a candidate is searched piece by piece, as if each stood alone.
    """
    out = []

    def allowed(s: str) -> bool:
        return len(s) < rules.window or s.isalpha() or any(p.fullmatch(s) for p in ALLOWED)

    for m in CANDIDATE.finditer(text):
        s = m[0].strip("=-_/+")
        if allowed(s):
            continue
        at = m.start() + m[0].index(s)
        found = [(at + a, at + b) for a, b in dense_windows(s, rules)]
        end = at + len(s)
        cuts = sorted((b[0], b[2]) for b in base if b[0] < end and at < b[2])
        if cuts:
            found = [x for x in found if not any(a < x[1] and x[0] < b for a, b in cuts)]
            for a, b in [*cuts, (end, end)]:
                piece = text[at:a].strip("=-_/+")
                if not allowed(piece):
                    start = at + text[at:a].index(piece)
                    found += [(start + x, start + y) for x, y in dense_windows(piece, rules)]
                at = max(at, b)
        for a, b in sorted(found):
            if out and a <= out[-1][2]:
                out[-1] = (out[-1][0], 3, max(b, out[-1][2]))
            else:
                out.append((a, 3, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each merged span replaced by ``mark``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, _, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scan_secrets(df: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """Find secrets in every whole text: id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans and, if asked, the redacted text.

    Spans are code points of the whole match, end exclusive, by start and kind.
    A null text is empty and has none (its redacted text stays null).  Ids may be null or repeated; an empty
    table gives no rows; other columns are not read.  One pass without a shuffle.
    """
    key = df.schema[id_col].dataType
    fields = [T.StructField("doc_id", key)] + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    fields += [T.StructField("redacted", T.StringType())] if redacted else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, spans, clean = [[], [], [], []], [], [], []
            for raw in batch.column(1):
                raw = raw.as_py()
                text = (raw or b"").decode("utf-8", "replace")
                base = base_spans(text)
                found = sorted(base + entropy_spans(text, base, rules))
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in found))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
                if redacted:
                    clean.append(None if raw is None else redact(text, found) if found else text)
            cols = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())]
            cols += [pa.array(clean, pa.string())] if redacted else []
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    raw = F.col(text_col).cast("binary") if redacted else utf8(text_col)
    return df.select(F.col(id_col).alias("doc_id"), raw.alias("raw")).mapInArrow(run, T.StructType(fields))


def redact_documents(df: DataFrame, rules: Rules = Rules(), text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns, each secret in the text replaced by a mark; ``chars_col`` follows where there is one."""
    at = df.columns.index(text_col)
    chars = df.columns.index(chars_col) if chars_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            texts, changed = cols[at].to_pylist(), False
            sizes = cols[chars].to_pylist() if chars is not None else None
            for i, t in enumerate(texts):
                if t and (found := (base := base_spans(t)) + entropy_spans(t, base, rules)):
                    texts[i], changed = redact(t, found), True
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            if changed:
                cols[at] = pa.array(texts, cols[at].type)
                if sizes is not None:
                    cols[chars] = pa.array(sizes, cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return df.mapInArrow(run, df.schema)
