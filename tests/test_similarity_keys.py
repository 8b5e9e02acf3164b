"""The similarity join makes few candidates where many signatures share single slots, and loses no pair."""

from itertools import combinations

import numpy as np
import pytest

from mmspark.functions import similarity


def signed(spark, rows):
    return spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(rows)], "rep long, signature array<long>")


def test_common_slots_make_no_candidates(spark):
    rows = np.arange(500 * 16).reshape(500, 16) + 10
    rows[:, [0, 3, 8]] = 1  # three words that all texts have
    assert similarity.candidates(signed(spark, rows), "signature", 16, 12).count() == 0


@pytest.mark.parametrize(("k", "threshold"), [(16, 0.75), (16, 1 / 16), (16, 1.0), (7, 0.5), (5, 0.8), (1, 0.5)])
def test_no_pair_is_lost(spark, k, threshold):
    rng = np.random.default_rng(k)
    rows = np.unique(np.where(rng.random((60, k)) < rng.random((60, 1)), 1, rng.integers(2, 1 << 40, (60, k))), axis=0)
    same = {(i, j): float((rows[i] == rows[j]).mean()) for i, j in combinations(range(len(rows)), 2)}
    found = similarity.similarity_join(signed(spark, rows), "rep", "signature", threshold, k).collect()
    assert sorted((r.id1, r.id2, r.similarity) for r in found) == sorted((*p, e) for p, e in same.items() if e >= threshold)
