"""Quality rules, rule ensemble and SimHash against plain Python."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm import quality_rules, queries, rule_ensemble, simhash
from tessera.llm.components import components
from tessera.llm.textstats import SHAPE, Batch, base_counts, shape

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def batch(texts):
    raws = [(t or "").encode() for t in texts]
    return Batch(np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64))


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(marked)}


ODD = ["", None, " ", "a", "\n", "a\na\na\n\n a\n", "x y z x y z", "é ü\x0bß\xa0q 日本 # * |", "w " * 3000, "line one\nline two\nline one", "a b c\r\na b c\r\n", "\na b\nb", "end\n"]


def test_base_counts(spark):
    texts = ODD + [r.text for r in queries.table(spark, SF, "documents").select("text").collect()] + ODD
    for x, ts in ((batch(texts), texts), (batch([]), []), (batch(["", ""]), ["", ""])):
        got = base_counts(x)
        for i, t in enumerate(ts):
            assert {k: int(v[i]) for k, v in got.items()} == brute(t), (i, t)


def test_shape_is_finite_and_local():
    x = shape(batch(ODD))
    assert x.shape == (len(ODD), len(SHAPE)) and np.isfinite(x).all()
    for i, t in enumerate(ODD):
        assert np.allclose(shape(batch([t]))[0], x[i])
    j = SHAPE.index("distinct")
    assert x[6][j] == pytest.approx(0.5) and x[8][j] == pytest.approx(1 / 3000)


def test_quality_rules(spark):
    docs, labels = queries.table(spark, "/root/testdata/sf0.01", "documents"), queries.table(spark, "/root/testdata/sf0.01", "labels")
    model = quality_rules.train(docs, labels)
    rows = {r.doc_id: r for r in quality_rules.score_quality(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for k, t in texts.items():
        b = brute(t)
        assert {n: rows[k][n] for n in b} == b
        failed = b["n_words"] < 50 or 100 * b["n_repeat_words"] > 50 * b["n_words"]
        assert rows[k].base_failed == failed and rows[k].kept == (not failed and rows[k].probability >= 0.5)
    want = {r.doc_id: r.quality for r in labels.collect()}
    right = np.mean([(rows[k].probability >= 0.5) == (q == 1) for k, q in want.items()])
    assert right > 0.9
    # a document's margin is the product of its sparse row and the weights
    x = batch(list(texts.values())[:5])
    m = quality_rules.margins(x, model.weights, model.bias)
    for d, (i, v) in enumerate(quality_rules.features(x)):
        assert m[d] == pytest.approx((model.weights[i] * v).sum() + model.bias, abs=1e-3)


def test_quality_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 1, "x"), (None, "a b", 2, "x"), (1, None, 1, "x")], "doc_id long, text string, kept int, n_words string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.train(docs, none) is None
    assert [r.kept for r in quality_rules.score_quality(docs, None).collect()] == [False] * 3
    assert quality_rules.score_quality(docs.limit(0), None).count() == 0
    model = rule_ensemble.train(docs, none)
    rows = rule_ensemble.score_documents(docs, model).collect()
    assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows) and rule_ensemble.score_documents(docs.limit(0), model).count() == 0


def test_rule_ensemble_held_out(spark):
    docs, labels = queries.table(spark, "/root/testdata/sf0.1", "documents"), queries.table(spark, "/root/testdata/sf0.1", "labels")
    model = rule_ensemble.train(docs, labels)
    rows = {r.doc_id: r for r in rule_ensemble.score_documents(docs, model).collect()}
    import zlib

    want = {r.doc_id: r.quality for r in labels.collect()}
    held = [k for k in want if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(rows[k].held_out for k in held) and not any(rows[k].held_out for k in want if k not in set(held))
    pos, neg = [rows[k].score for k in held if want[k] == 1], [rows[k].score for k in held if want[k] == 0]
    auc = np.mean([[(p > q) + 0.5 * (p == q) for q in neg] for p in pos])
    assert auc > 0.9
    assert np.mean([rows[k].predicted == want[k] for k in held]) > 0.9
    assert model.rules and len(model.rules) == len(model.weights)


def test_column_equals_numpy(spark):
    x = shape(batch(ODD + ["Some clean words here." * 5, "BAD!! %%% $$$"]))
    model = rule_ensemble.Ensemble([((0, ">", 1.0),), ((2, "<=", 0.5), (4, ">", 0.1))], [0.7, -1.5], 0.2)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in SHAPE))
    got = [r[0] for r in df.select(rule_ensemble.score_column(model)).collect()]
    want = 1 / (1 + np.exp(-(0.2 + 0.7 * rule_ensemble.holds(x, model.rules[0]) - 1.5 * rule_ensemble.holds(x, model.rules[1]))))
    assert np.allclose(sorted(got), sorted(want))


def brute_fp(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """Smallest id reachable; fps: list of (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = {}
    for i, (k, _) in enumerate(fps):
        r = find(i)
        ids[r] = min(x for x in (ids.get(r), k) if x is not None) if k is not None or r in ids else None
    return [ids[find(i)] for i in range(len(fps))]


def test_simhash_whole_table(spark):
    df = queries.table(spark, SF, "documents")
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "a"), (9, "zz")], "doc_id long, text string")
    df = df.select("doc_id", "text").union(extra)
    rows = simhash.near_duplicates(df).collect()
    texts = [(r.doc_id, brute_fp(r.text)) for r in df.collect()]
    want = Counter((k, f"{fp:016x}", c) for (k, fp), c in zip(texts, brute_components(texts)))
    assert Counter(tuple(r) for r in rows) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_hot_groups_link_the_same(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 1 << 63))
    fps = {centre}
    while len(fps) < 400:
        x = centre
        for b in rng.integers(0, 64, rng.integers(1, 7)):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 100)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    want = brute_components(list(enumerate(fps)))
    for group in (2, 16, 10_000):
        roots = {r.node: r.root for r in components(simhash.links(df, group=group)).collect()}
        got = [roots.get(simhash.signed(x), simhash.signed(x)) for x in fps]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_every_pair_has_a_chain():
    rng = np.random.default_rng(2)
    masks = simhash.chain_masks(7, 2)
    for _ in range(2000):
        x = 0
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            x |= 1 << int(b)
        assert any(all((x & ms[k - 1]).bit_count() <= k * 2 // 7 for k in range(1, 8)) for ms in masks)


def test_components_of_paths_and_stars(spark):
    edges = [(i + 1, i) for i in range(60)] + [(200, i) for i in range(100, 180)]
    edges = [(max(e), min(e)) for e in edges]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in [*range(101, 180), 200]}
