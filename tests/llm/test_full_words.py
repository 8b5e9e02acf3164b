"""Blocks whose rows fill their 64-bit words but for one, or wholly: numpy then lays the packed bits out another way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mmspark.llm.topk import top_k


@pytest.mark.parametrize("n", [63, 64, 127])
def test_blocks_of_nearly_whole_words(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    v = np.floor(256 * x.astype(float)).astype(int)
    want = [(q, r + 1, i, int(v[i] @ v[q])) for q in range(0, n, 50) for r, i in enumerate(sorted((i for i in range(n) if i != q), key=lambda i: (-(v[i] @ v[q]), i))[:5])]
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).collect())) == want
