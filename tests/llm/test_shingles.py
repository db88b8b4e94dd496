"""The pipeline's near-duplicate stage against all pairs of five-word shingle sets."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from tessera.llm import queries, shingles

from .test_quality_simhash import brute_fp


def brute_groups(texts):
    """The first index of each text's group: Jaccard of 4/5 on strings, or fingerprints within two bits."""
    sets = []
    for t in texts:
        ws = (t or "").encode().lower().split()
        sets.append({b" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    fps, up = [brute_fp(t) for t in texts], list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", None])
def test_stage_against_all_pairs(spark, sf):
    docs = queries.table(spark, sf or "/root/testdata/sf0.001", "documents")
    if sf is None:  # a chain of edited copies, more than fit a group, beside unlike texts that share lines
        rng = random.Random(3)
        word = lambda: f"w{rng.randrange(5000)}"
        base, texts = [word() for _ in range(100)], []
        for k in range(120):
            if k % 3 == 0:
                base = [*base]
                base[rng.randrange(100)] = word()
            edited = [*base]
            for _ in range(rng.randrange(4)):
                edited[rng.randrange(100)] = word()
            texts.append(" ".join(edited if k % 10 else [word() for _ in range(60)] + base[:25]))
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], docs.schema)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    want = [r for r, g, i in zip(rows, brute_groups([r.text for r in rows]), range(len(rows))) if g == i]
    got = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and len(got) < len(rows)
    if sf is None:
        assert Counter(map(tuple, shingles.keep_one(docs, group=2).collect())) == Counter(map(tuple, want))
