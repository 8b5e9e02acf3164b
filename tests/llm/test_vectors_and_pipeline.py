import os
import random

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from mmspark.llm import queries as Q
from mmspark.llm._graph import components
from mmspark.llm._spark import Steps, join_spread
from mmspark.llm.bpe import Codec
from mmspark.llm.embedding_dedup import embedding_dedup
from mmspark.llm.topk import SlicedIndex, top_k

SF = "/root/testdata/sf0.001"


def vectors(n=300, d=24, seed=1):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(6, d))
    rows = []
    for i in range(n):
        v = base[i % 6] + rnd.normal(scale=rnd.choice([0.0, 0.05, 0.2, 1.0]), size=d)
        rows.append((int(i * 5), [float(np.float32(x)) for x in v], int(i % 2)))
    return rows + [(9001, None, 1), (9002, [], 1), (9003, [0.0] * d, 1), (9004, [float("nan")] * d, 1), (9005, [None, *[1.0] * (d - 1)], 1), (9006, [1.0] * d, None), (9007, [2.0, 1.0], 1), (9008, [4.0, 2.0], 1)]


def expected_links(rows, threshold=0.98):
    ok = [(i, np.array(v, float), g) for i, v, g in rows if v and g is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, comp = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}
    for a in range(len(ok)):
        for b in range(a):
            (i, x, g), (j, y, h) = ok[a], ok[b]
            if g == h and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[i] += 1
                links[j] += 1
                lo, hi = sorted((comp[i], comp[j]))
                comp = {k: lo if c == hi else c for k, c in comp.items()}
    return {i: (links[i], comp[i], comp[i] == i) for i in links}


@pytest.mark.parametrize("tile", [32, 1024])
def test_embedding_dedup(spark, tile):
    rows = vectors()
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, label int, id long, copies int").repartition(3)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(df, tile=tile, sample=50).collect()}
    want = expected_links(rows)
    assert found == want and max(x[0] for x in want.values()) > 5
    assert embedding_dedup(df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_top_k(spark, block):
    rows = vectors(n=200)
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, q int").repartition(3)
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, x in ok:
        if q % 50 == 0:
            best = sorted((-int(x @ y), j) for j, y in ok if j != q and len(x) == len(y))[:5]
            want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    found = top_k(df, F.col("vec_id") % 50 == 0, block=block, queries_a_task=3, keep_bits=4).collect()
    assert sorted(map(tuple, found)) == sorted(want)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 1.0]), (1, [2.0, 2.0]), (None, [3.0, 3.0])], "vec_id long, embedding array<double>")
    s = 256 * 256
    assert sorted(map(tuple, top_k(two, F.col("vec_id") == 0).collect())) == sorted([(0, 1, 1, 6 * s), (0, 2, 0, 5 * s), (0, 3, 1, 3 * s)] * 2)


def test_top_k_of_large_components(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([1, 1e3, 7e4, 1e6, -1e6, 3e9]) * rnd.uniform(-1, 1) for _ in range(6)]) for i in range(120)] + [(200, [70000.0, 1.0] * 3), (250, [-0.0] * 6)]
    exact = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = []
    for q in exact:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(exact[q], v, strict=True)), j) for j, v in exact.items() if j != q)[:5]
            want += [(q, k + 1, j, max(-(2**63), min(2**63 - 1, -x))) for k, (x, j) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0, block=40).collect())) == sorted(want)
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [2e300, 0.0]), (3, [-3e300, 0.0]), (4, [-4e300, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [2, 1, 3, 4]


def test_sliced_sum():
    rnd = np.random.default_rng(0)
    v = rnd.integers(-300, 300, size=(130, 7))
    index = SlicedIndex(v, keep_bits=30)
    q = rnd.integers(-50, 50, size=7)
    total = index.add(q)
    bits = np.unpackbits(total.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(np.int64)
    got = (bits << np.arange(len(bits))[:, None]).sum(0)
    assert len(np.unique(got - v @ q)) == 1  # equal up to the block's constant


def test_components(spark):
    rnd = random.Random(0)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 900 + i) for i in range(50)]
    comp = {x: x for e in edges if e[0] != e[1] for x in e}
    for a, b in edges:
        if a != b:
            lo, hi = sorted((comp[a], comp[b]))
            comp = {k: lo if c == hi else c for k, c in comp.items()}
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == comp
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == list(corpus_pipeline.COLUMNS) and 0.97 * n <= kept.count() <= n
    rows = [(r.source, r.text) for r in docs.collect()]
    want = {x for x in brute.lines(rows, 0.3, 2, False) if x and any(y.strip() for y in x.split("\n"))}
    assert {r.text for r in corpus_pipeline.lines(spark, docs, SF).collect()} == want
    first = {i for i, (_, c) in brute.join([(r.doc_id, r.text) for r in docs.collect()], 5, 80).items() if i == c}
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()} == first


def test_pipeline_edges(spark):
    live = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"
    rows = [(1, f"the water token={live} is here", "en", "a", 0), (1, f"the water token={live} is here", "en", "a", 0), (None, f"no id token={live}", "en", "a", 0), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted(map(tuple, corpus_pipeline.secrets(spark, docs, SF).select("doc_id", "text").collect()), key=str)
    assert found == sorted([(1, "the water [SECRET] is here"), (1, "the water [SECRET] is here"), (None, "no id [SECRET]"), (3, None)], key=str)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_copies(spark, docs, SF).collect()) == ["1", "1", "3", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_pipeline_of_null_ids(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(None, "12345 !!! ???", None, None, 0), (None, None, None, None, None), (None, "", "en", "z", 0)]
    docs = base.withColumn("doc_id", F.lit(None).cast("long")).unionByName(spark.createDataFrame(rows, base.schema)).withColumn("row", F.lit(1))
    kept = corpus_pipeline.language(spark, docs, SF)
    texts = [r.text for r in kept.collect()]
    assert "12345 !!! ???" not in texts and None not in texts and len(texts) > 0.9 * base.count()
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert {r.doc_id for r in stage(spark, docs, SF).collect()} == {None}
    assert corpus_pipeline.near_copies(spark, docs, SF).count() == docs.count()


def test_pipeline_against_brute_force(spark):
    """Line dedup, near copies, redaction and packing by plain Python, on what the language stage keeps."""
    kept = [r.asDict() for r in corpus_pipeline.language(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()]
    for r, t in zip(kept, brute.lines([(r["source"], r["text"]) for r in kept], 0.3, 2, False), strict=True):
        r["text"] = t
    kept = [r for r in kept if any(x.strip(" \t\r") for x in r["text"].split("\n"))]
    first = {i for i, (_, c) in brute.join([(r["doc_id"], r["text"]) for r in kept], 5, 80).items() if i == c}
    kept = [r for r in kept if r["doc_id"] in first]
    texts = {r["doc_id"]: brute.redacted([(x["text"], x["source"], x["doc_id"]) for x in kept], k) for k, r in enumerate(kept)}
    c = Codec(Q.tokenizer_file("word_bpe_49k.json"))
    want = {i: len(c.tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_steps_are_deleted(spark):
    steps = Steps(spark)
    one = steps.keep(spark.range(3))
    assert one.count() == 3 and len(os.listdir(steps.folder)) == 1
    steps.drop(one)
    assert os.listdir(steps.folder) == []
    steps.close()
    assert not os.path.exists(steps.folder)


def test_hot_keys_are_spread(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got = sorted(map(tuple, join_spread(left, right, "k", "id", how, rows=100).select("k", "id", "v").collect()), key=str)
        assert got == sorted(map(tuple, left.join(right, "k", how).select("k", "id", "v").collect()), key=str)


def test_pipeline_run(spark):
    found = corpus_pipeline.run(spark, SF).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for pieces in by.values():
        at = 0
        for start, length, _ in sorted(pieces):
            assert start == at
            at += length
        assert at == pieces[0][2]
