"""Components of few edges in one task, against the rounds of steps."""

import numpy as np

from tessera.llm import components


def test_few_edges_take_one_task(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ends = rng.integers(-(2**62), 2**62, 400)[rng.integers(0, 400, (500, 2))]
    chain = [(k + 1, k) for k in range(10_000, 10_300)]
    edges = spark.createDataFrame([(int(max(e)), int(min(e))) for e in ends if e[0] != e[1]] + chain, "u long, v long")
    want = sorted(map(tuple, components.components(edges, at_once=0).collect()))
    monkeypatch.setattr(components, "_large_star", None)  # the rounds may not be called
    got = sorted(map(tuple, components.components(edges).collect()))
    assert got == want and (10_300, 10_000) in got
    assert components.components(edges.limit(0)).collect() == []
