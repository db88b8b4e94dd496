"""The longer keys of hot groups: complete for every pair, bounded, and linking what all pairs link."""

import itertools
import random

from tessera.llm import simhash

from .test_quality_simhash import brute_components


def test_every_pair_meets_at_every_level():
    starts, some, most = simhash.longer_keys()
    chains = simhash.chain_masks(7, 2)
    for bits in [(), *itertools.combinations(range(64), 1), *itertools.combinations(range(64), 2)]:
        x = sum(1 << b for b in bits)
        good = [i for i in range(7) if all((x & chains[i][k - 1]).bit_count() <= k * 2 // 7 for k in range(1, 8))]
        assert good
        for i in good:  # whichever chain holds the pair, its longer keys hold it too
            assert not x & starts[0][i]
            met = [3 * i + e for e in range(3) if not x & some[i][e]]
            assert met and all(any(not x & m for m in most[j]) for j in met)
    assert all(64 - m.bit_count() <= 10 for masks in most for m in masks)


def test_dense_clusters(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    # 300 fingerprints that share 46 bits, and neighbours of some anywhere
    low = [simhash.longer_keys()[1][0][0] ^ ((1 << 64) - 1)] * 300
    fps = {centre ^ (rng.getrandbits(64) & mask) for mask in low} | {centre}
    fps |= {x ^ (1 << rng.randrange(64)) for x in rng.sample(sorted(fps), 40)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    want = {(a, b) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2 and simhash.signed(a) > simhash.signed(b)}
    for group in (1, 8, 32, 10_000):
        got = {(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in simhash.links(df, group).collect()}
        assert got == want
    assert len(set(brute_components(list(enumerate(fps))))) < len(fps)
