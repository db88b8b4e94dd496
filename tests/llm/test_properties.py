"""Properties of the pure parts, on generated inputs."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import byte_bpe, html_text, secrets, sharding, suffix_dedup

quick = settings(max_examples=60, deadline=None)


@quick
@given(st.integers(1, 6), st.integers(1, 5), st.data())
def test_overflow_plan_places_every_row(n_shards, vnodes, data):
    points = [(i, data.draw(st.integers(0, n_shards - 1))) for i in range(n_shards * vnodes)]
    points = [(i, i % n_shards if i < n_shards else s) for i, s in points]  # every shard has a point
    counts = {i: data.draw(st.integers(0, 30)) for i in range(len(points))}
    n = sum(counts.values())
    caps = sharding.capacities(n, n_shards, data.draw(st.sampled_from([1.0, 1.3])))
    plan = sharding.overflow_plan(points, counts, caps)
    assert len(plan) <= len(points) + n_shards
    for arc, m in counts.items():
        ranks = [r for a, lo, hi, _, _ in plan if a == arc for r in range(lo, hi)]
        assert sorted(ranks) == list(range(m))
    for s in range(n_shards):
        slots = [base + k for _, lo, hi, shard, base in plan if shard == s for k in range(hi - lo)]
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= caps[s]


@quick
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=20, unique=True), st.lists(st.integers(-(2**63), 2**63 - 1), max_size=30))
def test_ring_intervals_give_the_next_point(positions, hashes):
    points = [(p, i) for i, p in enumerate(sorted(positions))]
    ring = sharding.ring_intervals(points)
    for h in [*hashes, -(2**63), 2**63 - 1, *positions]:
        prefix = h >> (64 - sharding.RING_BITS)
        arcs = [a for p, lo, hi, a in ring if p == prefix and lo <= h <= hi]
        assert arcs == [next((i for p, i in points if p >= h), 0)]


@quick
@given(st.text(alphabet="ab 1'.\né　", max_size=200), st.integers(1, 50))
def test_safe_parts_are_the_text(text, most):
    assert "".join(byte_bpe.safe_parts(text, most)) == text


@quick
@given(st.lists(st.binary(min_size=0, max_size=60).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=6))
def test_anchors_cover_every_start(raws):
    span, k = 12, 4
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
    x = suffix_dedup.anchors(np.frombuffer(b"".join(raws), np.uint8), offs, span, k)
    starts = Counter((int(d), int(lo) + i) for d, lo, run in zip(x["doc"], x["lo"], x["run"]) for i in range(int(run) + 1))
    assert starts == Counter((d, i) for d, r in enumerate(raws) for i in range(len(r) - span + 1))
    # equal strings have equal anchors at equal distances
    at = {}
    for d, lo, left, run, cls in zip(*(x[c].tolist() for c in ("doc", "lo", "left", "run", "class"))):
        for i in range(run + 1):
            s = raws[d][lo + i : lo + i + span]
            assert at.setdefault(s, (cls, left - i)) == (cls, left - i)
            assert 0 <= left - i <= span - k


@quick
@given(st.text(alphabet="<>/=\"' abp!-&;#x\n", max_size=300))
def test_any_markup_is_read(page):
    parts = html_text.segments(page)
    text = html_text.main_text(page, html_text.own_role(parts))
    assert text == " ".join(text.split())


@quick
@given(st.text(alphabet="abAK9_=: \"tokens/+", max_size=200))
def test_redaction_leaves_the_rest(text):
    base = secrets.base_spans(text)
    spans = base + secrets.entropy_spans(text, base, secrets.Rules())
    clean = secrets.redact(text, spans, "")
    gone = {i for a, _, b in spans for i in range(a, b)}
    assert clean == "".join(c for i, c in enumerate(text) if i not in gone)
