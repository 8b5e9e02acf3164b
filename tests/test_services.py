"""Services, checkpoints, the tail loop, bounds, plans of stored indexes and edges."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mmspark.functions import similarity
from mmspark.functions.text import AnalyzerConfig, normalize, tokenize
from mmspark.operators import cdc, indexing, search, traversal
from mmspark.plans.specs import CdcOptions, TraversalSpec, dirty_read_headers, fresh_enough
from mmspark.sources import backup
from mmspark.sources.folders import shared, write_text
from mmspark.streaming import applier
from mmspark.streaming.tail import TailLoop


def test_normalize():
    default = '{"numHashes":128,"analyzer":{"type":"delimiter","properties":{"delimiter":" "}}}'
    assert normalize("") == default and normalize("{}") == default
    assert normalize('{"numHashes": -1}') is None and normalize('{"numHashes": 99999}') is None
    assert normalize('{"numHashes": 64}') == '{"numHashes": 64}'
    assert AnalyzerConfig.make('{"numHashes": 8}').num_hashes == 8


def test_accuracy_of_the_estimate(spark):
    """Sets of 1000 elements with a shared part; estimates with k = 128 that the definition gives."""
    want = {10: 0.0156, 25: 0.1406, 50: 0.3672, 75: 0.6250, 90: 0.8359}
    rows = []
    for percent in want:
        n = percent * 10
        rows.append((percent, *([f"shared_{i}" for i in range(n)] + [f"only{x}_{i}" for i in range(n, 1000)] for x in "AB")))
    df = spark.createDataFrame(rows, "percent int, a array<string>, b array<string>")
    both = similarity.minhash(similarity.minhash(df, "a", 128, "s"), "b", 128, "t")
    found = {r.percent: r.e for r in both.select("percent", similarity.estimate_jaccard(F.col("s"), F.col("t")).alias("e")).collect()}
    assert {k: round(v, 4) for k, v in found.items()} == want


def test_signature_forms(spark):
    df = spark.createDataFrame([(1, "b a\tb", ["a", "b", None]), (2, "", []), (3, None, None), (4, "é x", ["x", "é", "x"])], "i int, text string, toks array<string>")
    both = similarity.minhash(similarity.minhash(df, "text", 9, "s"), "toks", 9, "t").collect()
    assert all(r.s == r.t for r in both) and both[1].s == [-1] * 9 and both[2].s is None
    bad = spark.range(1).select(similarity.minhash_match(F.array(F.lit(1)), F.array(F.lit(1)), 1.5).alias("x")).first().x
    assert bad is None


def test_registered_functions(spark):
    similarity.register(spark)
    row = spark.sql("SELECT size(MINHASH(array('a', 'b'))) AS n, JACCARD(array('a', 'b'), array('b', 'c')) AS j, MINHASH_MATCH(array(1L, 2L), array(1L, 3L), 0.5D) AS m, MINHASH_MATCH(array(1L), array(1L), 2D) AS bad").first()
    assert (row.n, round(row.j, 6), row.m, row.bad) == (128, 0.333333, True, None)


def test_similarity_classes_and_pairs(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "a b c e"), (4, ""), (5, " "), (6, "zz"), (7, None)]
    s = similarity.minhash(spark.createDataFrame(rows, "id long, text string"), "text", 64)
    assert {r.id: r.class_id for r in similarity.similarity_classes(s, "id", "signature").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: None}
    pairs = similarity.similarity_join(s, "id", "signature", 0.3, 64).collect()
    assert [(r.id1, r.id2) for r in pairs] == [(1, 3)]


def test_stored_index(spark):
    rnd = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(words, p=np.arange(30, 0, -1) / 465, size=int(rnd.integers(1, 30))))) for i in range(300)] + [(999, None)], "doc_id long, text string")
    index = search.build_index(docs)
    assert index.documents == 301
    for terms, k in ((["w0", "w1", "w29"], 5), (["w3"], 7), (["w28", "w29", "w0", "none"], 3), ([], 4), (["w1"], 0)):
        plain, pruned = (search.top_k(index, terms, k, prune=p).collect() for p in (False, True))
        assert plain == pruned
        full = search.bm25(index, terms).orderBy(F.desc("score"), "doc_id").limit(k).collect()
        assert [r.doc_id for r in plain] == [r.doc_id for r in full]
    only = docs.where("doc_id % 3 = 0")
    assert search.top_k(index, ["w0", "w25"], 5, only).collect() == search.top_k(index, ["w0", "w25"], 5, only, prune=True).collect()
    plan = search.scored(index, search.known_terms(index, ["w5"]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan and "EqualTo(term,w5)" in plan
    docs_ = [(1, 8.0, 10.0), (2, 1.0, 0.5)]
    assert search.wand_context(docs_, False, 2) is docs_ and search.wand_context(docs_, True, 0) is docs_ and list(search.wand_context(docs_, True, 1)) == [(1, 8.0)]
    assert spark.range(1).select(tokenize(F.lit(" a  b ")).alias("t")).first().t == ["a", "b"]


def test_prefix_partitions(spark):
    edges = spark.createDataFrame([("v/eu:1", "v/eu:2"), ("v/eu:2", "v/eu:3"), ("v/us:1", "v/us:2"), ("v/eu:1", "v/us:2")], "_from string, _to string")
    stored = traversal.write_edges(edges, shared(spark, "edges"))
    found = traversal.paths(stored, "v/eu:1", 1, 3, disjoint=True)
    assert sorted((r.vertex, r.depth) for r in found.collect()) == [("v/eu:2", 1), ("v/eu:3", 2)]
    assert "PartitionFilters: [isnotnull(smart_prefix" in found._jdf.queryExecution().executedPlan().toString()
    line = spark.createDataFrame([(f"v/{i}", f"v/{i + 1}") for i in range(6)], "_from string, _to string")
    assert traversal.shortest_path(line, "v/0", "v/4").first().depth == 4
    assert traversal.shortest_path(line, "v/0", "v/6", max_depth=3).collect() == [] and traversal.shortest_path(line, "v/0", "v/0").first().depth == 0


def test_smart_hop(spark):
    edges = spark.createDataFrame([("v/eu:1", "v/eu:2"), ("v/eu:1", "v/us:2"), ("v/us:2", "v/us:3"), ("v/eu:2", "v/eu:1"), ("v/eu:2", "v/eu:3")], "_from string, _to string")
    frontier = traversal.paths(edges, "v/eu:1", 1, 1)
    done, waiting = traversal.smart_hop(frontier, traversal.oriented(edges, "OUTBOUND"), "eu")
    assert [(r.vertex, r.depth, r.path) for r in done.collect()] == [("v/eu:3", 2, ["v/eu:1", "v/eu:2", "v/eu:3"])]
    assert [r.vertex for r in waiting.collect()] == ["v/us:2"]
    there, none = traversal.smart_hop(waiting, traversal.oriented(edges, "OUTBOUND"), "us")
    assert [r.vertex for r in there.collect()] == ["v/us:3"] and none.isEmpty()


def test_control():
    c = cdc.Control(states={"s1": {"generated": 100, "applied": 50}, "s2": {"generated": 5, "applied": 5}}, sent=20, acked=10, clock=lambda: 7.5)
    assert c.route("start") == {"error": False, "code": 200, "result": {"started": True, "timestamp": 7, "previousState": "stopped"}}
    assert c.start()["code"] == 409 and c.route("nosuch")["code"] == 404
    status = c.status()["result"]
    assert status["isRunning"] and status["lagSeconds"] == 100.0 and status["totalPending"] == 50
    assert status["shardStates"][0] == {"shardId": "s1", "lastGenerated": 100, "lastApplied": 50, "pending": 50}
    assert [c.checkpoint(*x)["code"] for x in (("", 1), ("s1", 0), ("s1", 101), ("s1", 50), ("s9", 1), ("s1", 75), ("s1", 75), ("s1", 100))] == [400, 400, 409, 409, 409, 200, 409, 200]
    assert c.checkpoint("s9", 1)["errorMessage"] == "unknown shard: s9" and "exceeds lastGenerated 100" in c.checkpoint("s1", 101)["errorMessage"]
    assert c.reset()["result"] == {"reset": True, "shardsReset": 2} and c.stop()["code"] == 200 and c.stop()["code"] == 409


def test_feed_route(spark):
    c = cdc.Control(feeds={"s": spark.range(1, 11).select(F.col("id").alias("sequence"), F.lit("p").alias("payload"))})
    page = c.feed("s", 0, 3)["result"]
    assert [m["sequence"] for m in page["messages"]] == [1, 2, 3] and page["hasMore"] and page["lastSequence"] == 3
    assert c.feed("s", 10)["result"] == {"shardId": "s", "messages": [], "hasMore": False, "lastSequence": 10}
    assert c.feed("")["code"] == 400 and c.feed("x")["result"]["messages"] == []


def test_checkpoint_rules(spark):
    rows = [(75, 100, 50), (100, 100, 50), (150, 100, 50), (75, 100, 75), (50, 100, 75), (1, 0, 0), (1, None, None)]
    df = spark.createDataFrame(rows, "r long, g long, a long").select("*", cdc.checkpoint_check(F.col("r"), F.col("g"), F.col("a")).alias("v"))
    assert [r.v.error for r in df.collect()] == [None, None, "exceeds lastGenerated", *["not ahead of current lastApplied"] * 2, "unknown shard", "unknown shard"]


def test_status_report(spark):
    states = spark.createDataFrame([("a", 100, 90), ("b", 200, 150), ("c", 300, 280)], "shard string, last_generated long, last_applied long")
    report = cdc.status_report(states, True, 0, 0)
    assert report["totalPending"] == 80 and report["lagSeconds"] == 50.0 and [s["pending"] for s in report["shardStates"]] == [10, 50, 20]
    assert cdc.status(states, 20, 10).first().lag_estimate == 100


def test_durable_checkpoint(spark):
    path = f"{shared(spark, 'checkpoint')}/c.json"
    assert applier.checkpoint_load(spark, path) == {}
    applier.checkpoint_save(spark, path, {"a": 3})
    applier.checkpoint_save(spark, path, {"a": 4, "b": 1})
    assert applier.checkpoint_load(spark, path) == {"a": 4, "b": 1}
    write_text(spark, path, '{"version": 2}')
    with pytest.raises(ValueError):
        applier.checkpoint_load(spark, path)


def test_tail_loop(spark):
    folder, source = shared(spark, "tail"), shared(spark, "wal")
    schema = "seq long, micros long, collection string, shard string, key string"
    rows = [(i, i * 10, "sat" if i % 5 == 0 else "users", f"s{i % 2}", f"k{i}") for i in range(1, 41)]
    loop = TailLoop(spark, folder, CdcOptions(batch_size=4), satellites=["sat"])
    for part in (rows[:15], rows[15:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        loop.start(spark.readStream.schema(schema).parquet(source), available_now=True).awaitTermination()
    found = sorted((r.shard, r.sequence, r.seq, r.batch) for r in loop.messages().collect())
    for shard in ("s0", "s1"):
        mine = [x for x in found if x[0] == shard]
        assert [x[1] for x in mine] == list(range(1, len(mine) + 1))
        assert [x[2] for x in mine] == [r[0] for r in rows if r[3] == shard and r[2] != "sat"]
        assert all(sum(x[3] == b for x in mine) <= 4 for b in {x[3] for x in mine})
    loop._poll(spark.createDataFrame(rows[15:], schema), 1)  # a micro-batch that is run again
    assert sorted((r.shard, r.sequence, r.seq, r.batch) for r in loop.messages().collect()) == found
    assert applier.checkpoint_load(spark, f"{folder}/checkpoint.json") == {"s0": 16, "s1": 16}
    assert {r.shard: r.exceeds for r in loop.lag(10**9).collect()} == {"s0": True, "s1": True}


def test_backup_service(spark, tmp_path):
    service = backup.Service(spark, str(tmp_path / "b"))
    assert service.run("list")["result"] == [] and service.run("nosuch")["code"] == 404
    made = service.run("create", tables={"t": spark.range(3)}, label="x")["result"]
    assert made["collections"] == ["t"] and made["isConsistent"] and [e["id"] for e in service.run("list")["result"]] == [made["id"]]
    assert service.run("restore", name=made["id"])["code"] == 200 and service.run("restore", name="none")["code"] == 404
    (tmp_path / "b" / "empty").mkdir()
    assert service.run("restore", name="empty")["code"] == 400
    assert service.run("delete", name=made["id"])["result"] == {"deleted": True, "id": made["id"]} and service.run("delete", name=made["id"])["code"] == 404
    for text in ("{}", '{"backupId": "x"}'):
        with pytest.raises(ValueError):
            backup.Manifest.from_json(text)


def test_bounds_and_builds(spark):
    assert [lo for lo, _ in indexing.range_bounds("a", "z", 4)] == ["a", "g", "m", "s"] and indexing.range_bounds("a", "z", 4)[-1][1] == "z"
    assert indexing.range_bounds("a", "z", 0) == [] and indexing.range_bounds("z", "a", 3) == [] and indexing.range_bounds("a", "b", 1) == [("a", "b")]
    for low, high, n in (("aa", "ab", 9), ("", "z", 64), ("user:1", "user:2", 5), ("m", "", 3)):
        cuts = indexing.range_bounds(low, high, n)
        assert len(cuts) == n and all(a < b or not b for a, b in cuts) and all(x[1] == y[0] for x, y in zip(cuts, cuts[1:], strict=False))
    keys = spark.createDataFrame([(f"k{i:04d}",) for i in range(500)], "k string")
    assert [r.key for r in indexing.split_points(keys, "k", 4).orderBy("part").collect()] == ["k0125", "k0250", "k0375"]
    log = indexing.Changelog(300)
    assert log.append("INSERT", "é", "r", b"abc") and log.used == 111 and not log.append("INSERT", "k", "r", b"x" * 200)
    b = indexing.Build(background=True)
    assert not b.buffers_writes and b.advance() == "Building" and b.buffers_writes and [b.advance() for _ in range(4)] == ["ApplyingChangelog", "Swapping", "Complete", "Complete"] and b.fail() == "Failed"


def test_options_and_flags():
    with pytest.raises(ValueError):
        CdcOptions(enabled=True)
    assert CdcOptions(enabled=True, target="x").batch_size == 1000
    spec = TraversalSpec(graph="g", satellite=True, one_shard=True)
    assert TraversalSpec.from_data(spec.to_data()) == spec and spec.local and spec.memory_bytes() > TraversalSpec().memory_bytes()
    assert dirty_read_headers(True, "h") == {"h": "true"} and dirty_read_headers(False, "h") == {}
    assert str(fresh_enough(F.lit(9), 0, eventual=True)) == str(F.lit(True))
    assert TraversalSpec(smart=True).runs_on_one_shard(True) and not TraversalSpec().runs_on_one_shard(True)
    assert json.loads(applier.checkpoint_text({"a": 1})) == {"version": 1, "shards": {"a": 1}}
