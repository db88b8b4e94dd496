"""Every pipeline stage against brute force on its own input, and odd rows through all of them."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from tessera.llm import byte_bpe, queries, quality_rules
from tessera.llm import secrets as sc
from tessera.llm.decontaminate import Limits

from .test_decontaminate import plain_score, words
from .test_quality_simhash import brute, brute_components, brute_fp
from .test_tokens_shards_secrets import brute_base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """Each stage's input and output, written and read again."""
    docs = queries.table(spark, SF, "documents")
    out, where = [], tmp_path_factory.mktemp("stages")
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        got = f(spark, docs, SF)
        got.write.parquet(f"{where}/{i}")
        after = spark.read.parquet(f"{where}/{i}")
        out.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_quality_stage(spark, outputs):
    before, after, _ = outputs[0]
    model = quality_rules.train(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels"))
    p = {r.doc_id: r.probability for r in quality_rules.score_quality(queries.table(spark, SF, "documents"), model).collect()}
    want = [r for r in before if (b := brute(r.text))["n_words"] >= 50 and 100 * b["n_repeat_words"] <= 50 * b["n_words"] and (model is None or p[r.doc_id] >= 0.5)]
    assert Counter(map(tuple, after)) == Counter(map(tuple, want)) and 0 < len(after) < len(before)


def test_near_duplicate_stage(outputs):
    before, after, _ = outputs[1]
    comp = brute_components([(r.doc_id, brute_fp(r.text)) for r in before])
    want = [r for r, c in zip(before, comp) if r.doc_id == c]
    assert Counter(map(tuple, after)) == Counter(map(tuple, want)) and len(after) < len(before)


def test_decontamination_stage(spark, outputs):
    before, after, _ = outputs[2]
    items = [words(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    leaked = lambda ws: any(set(it) & set(ws) and len(set(it) & set(ws)) >= 3 and plain_score(it, ws) >= Limits().similarity * len(it) - 1e-9 for it in items)
    want = [r for r in before if not leaked(words(r.text))]
    assert Counter(map(tuple, after)) == Counter(map(tuple, want))


def test_secret_stage(outputs):
    before, after, cols = outputs[3]
    assert cols == ["doc_id", "text", "lang", "source", "n_chars"] and len(before) == len(after)
    new = {r.doc_id: r for r in after}
    for r in before:
        base = brute_base(r.text)
        assert not brute_base(new[r.doc_id].text) and new[r.doc_id].n_chars == len(new[r.doc_id].text)
        if not base and not sc.entropy_spans(r.text, base, sc.Rules()):
            assert new[r.doc_id] == r


def test_encode_stage(outputs):
    before, after, _ = outputs[4]
    enc = byte_bpe.encoding(queries.BYTE_RANKS, queries.public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in after}
    assert len(after) == len(before)
    for r in before:
        ids = enc.encode_ordinary(r.text)
        assert got[r.doc_id].ids == ids and got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run_equals_the_stages(spark, outputs):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in outputs[-1][1])


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long, None, None, None), (1, long, None, None, None), (None, long + " x", "en", "s", 5), (None, None, None, None, None), (2, "", "en", "s", 0), (3, long.upper() + " token = abcdefgh", "en", "s", 9)]
    df = spark.createDataFrame(rows, queries.table(spark, SF, "documents").schema)
    out = df
    for _, f in corpus_pipeline.STAGES:
        out = f(spark, out, SF)
        assert f(spark, df.limit(0), SF).count() == 0
    groups = lambda some: len(set(brute_components([(i, brute_fp(r[1])) for i, r in enumerate(some)])))
    assert out.count() == groups([r for r in rows if r[1] and len(r[1]) > 9])
    from tessera.llm import simhash

    kept = [r.doc_id for r in simhash.keep_one(df).collect()]
    assert len(kept) == groups(rows) and kept.count(1) == 1 and None not in kept
    clash = df.selectExpr("*", "1 as __fp", "2 as __row", "'f' as __file", "3 as probability", "4 as kept", "5 as raw", "6 as item_id")
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, clash, SF).columns == clash.columns
    assert len(simhash.keep_one(clash).collect()) == len(kept)
    redacted = [r.text for r in sc.redact_documents(df).collect()]
    assert sum("[SECRET]" in (t or "") for t in redacted) == 1 and redacted.count(None) == 1
