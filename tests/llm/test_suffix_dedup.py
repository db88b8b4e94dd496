"""Exact-substring dedup against counting every string."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import queries
from tessera.llm import suffix_dedup as sd


def brute(texts, span):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + span] for r in raws for i in range(len(r) - span + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


def random_texts(seed, span):
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared = [word(span + int(rng.integers(-5, 3 * span))) for _ in range(6)]
    texts = [None, "", "a" * (5 * span), "b" * span, "ab" * span + "x" + "ab" * span, word(3)]
    for _ in range(40):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            s = shared[int(rng.integers(0, 6))]
            a, b = sorted(rng.integers(0, len(s) + 1, 2))
            parts += [word(int(rng.integers(0, span // 2))), s[a:b] if rng.integers(0, 2) else s]
        texts.append("".join(parts))
    return texts + texts[8:12] + [texts[9]]


@pytest.mark.parametrize("seed,span,k,rows", [(0, 40, 10, 4096), (1, 40, 10, 2), (2, 24, 12, 8)])
def test_random_texts(spark, monkeypatch, seed, span, k, rows):
    monkeypatch.setattr(sd, "CLASS_ROWS", rows)
    texts = random_texts(seed, span)
    df = spark.createDataFrame([(i if i % 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, class string")
    got = Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(df, span, k).collect())
    want = brute(texts, span)
    assert sum(w[1] for w in want) > 0 and got == Counter(want)


def test_whole_table(spark):
    df = queries.table(spark, "/root/testdata/sf0.001", "documents")
    rows = {r.doc_id: tuple(r)[1:5] for r in sd.remove_repeats(df, keep_text=True).collect()}
    docs = df.collect()
    assert rows == {d.doc_id: w for d, w in zip(docs, brute([d.text for d in docs], 400))}
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_sliding_min():
    rng = np.random.default_rng(0)
    for n, w in ((1, 1), (10, 3), (12, 4), (100, 37)):
        a = rng.integers(0, 50, n).astype(np.uint64)
        assert sd.sliding_min(a, w).tolist() == [int(a[i : i + w].min()) for i in range(n - w + 1)]
