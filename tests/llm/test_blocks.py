"""Links of fingerprints by any number of blocks against all pairs."""

import numpy as np
import pytest

from factspan.llm import simhash


def test_more_fingerprints_have_more_blocks():
    assert [simhash._blocks(n) for n in (0, 10 ** 8, 10 ** 9, 10 ** 10, 10 ** 12)] == [5, 5, 6, 6, 7]
    assert [len(simhash._masks(0, b)) for b in (5, 6, 7)] == [10, 20, 35]


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_all_links_are_found(spark, blocks):
    rng = np.random.default_rng(blocks)
    near = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    fps = set(near)
    for x in near:
        for _ in range(12):
            fps.add(x ^ sum(1 << int(b) for b in set(rng.integers(0, 64, int(rng.integers(1, 5))).tolist())))
    fps = sorted(fps)
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if bin(a ^ b).count("1") <= 3}
    frame = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for above in (128, 3):
        got = {tuple(sorted(x & (1 << 64) - 1 for x in r)) for r in simhash.links(frame, split_above=above, blocks=blocks).collect()}
        assert got == want
