"""Decontamination against a plain Smith-Waterman of every item with every whole text."""

import re

import numpy as np
import pytest

from tessera.llm import decontaminate as dc
from tessera.llm import queries


def plain_score(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, prev[j] + (1 if x == y else -1), prev[j + 1] - 1, row[-1] - 1))
        best, prev = max(best, *row), row
    return best


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def edited(rng, ws, k):
    ws = list(ws)
    for _ in range(k):
        i = int(rng.integers(0, len(ws)))
        kind = rng.integers(0, 3)
        if kind == 0:
            ws[i] = f"new{rng.integers(0, 99)}"
        elif kind == 1:
            ws.insert(i, "extra")
        else:
            del ws[i]
    return ws


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(-1, 5, rng.integers(0, 20))
        score, matches, s, e = dc.smith_waterman(a, b)
        assert score == plain_score(a.tolist(), b.tolist())
        if score:
            assert plain_score(a.tolist(), b[s:e].tolist()) == score and matches >= score


def test_planted_copies(spark):
    rng = np.random.default_rng(1)
    bench = [(r.item_id, r.text) for r in queries.table(spark, "/root/testdata/sf0.001", "benchmark").collect()] + [(100, "two words"), (101, None), (102, "..."), (103, "one two three four")]
    texts = [r.text for r in queries.table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()]
    docs = [(i, t) for i, t in enumerate(texts)]
    for i, (k, t) in enumerate(bench[:36]):
        w = edited(rng, words(t), i % 12)
        docs.append((1000 + i, " ".join(words(texts[i % len(texts)])[:40] + w + words(texts[(i + 7) % len(texts)])[:40])))
    docs += [(2000, None), (2001, ""), (2002, "Two, WORDS"), (None, "x one two three five four y"), (2003, bench[0][1]), (2003, bench[0][1])]
    d = spark.createDataFrame([(a, b, "c") for a, b in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, round(r.similarity, 9)) for r in dc.find_leaks(d, b).collect()), key=str)
    want = []
    for k, t in docs:
        dw = words(t)
        for i, bt in bench:
            bw = words(bt)
            if bw and (s := plain_score(bw, dw)) >= (dc.Limits().similarity if len(bw) >= 3 else 1) * len(bw) - 1e-9:
                want.append((k, i, round(s / len(bw), 9)))
    assert got == sorted(want, key=str)
    assert {x[0] for x in got} >= {1000, 1001, 1002, 2002, 2003}
    blocks = dc.find_leaks(d, b, dc.Limits(block_items=7))
    assert sorted(((r.doc_id, r.item_id, round(r.similarity, 9)) for r in blocks.collect()), key=str) == got


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.find_leaks(d, b.limit(0)).count() == 0 and dc.find_leaks(d.limit(0), b).count() == 0
    assert dc.find_leaks(d, b).first().similarity == pytest.approx(1.0)
