"""Parity vectors of the reference operators, and every registered query against its SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from mmspark import registry
from mmspark.functions import masking, similarity, smartkeys
from mmspark.functions.hashing import fnv1a32, permutation_seeds
from mmspark.operators import cdc
from mmspark.operators.search import Pruned, Threshold
from mmspark.plans.specs import FollowerRouter, PlanNode, Satellites, TraversalSpec, annotate_top_k

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_hashes(spark):
    assert [one(spark, fnv1a32(F.lit(s))) for s in ("eu", "us", "", "é")] == [1209692303, 1178800089, 2166136261, 513665217]
    assert permutation_seeds(2) == [(1768020134371600955, 520025364750119766), (1766520436317415110, 521525062804305600)]


def test_signatures(spark):
    df = spark.createDataFrame([(["hello", "world"],), ([],), (None,)], "t array<string>")
    found = [r.signature for r in similarity.minhash(df, "t", 4).collect()]
    assert found == [[253377063334866536, 210200663516731326, 1037428427303914902, 1752260606426539786], [-1] * 4, None]
    two = spark.createDataFrame([(list("abcd"), list("cdef"))], "a array<string>, b array<string>")
    row = similarity.minhash(similarity.minhash(two, "a", 128, "s"), "b", 128, "r").select(similarity.estimate_jaccard(F.col("s"), F.col("r")).alias("e"), similarity.jaccard(F.col("a"), F.col("b")).alias("j")).first()
    assert row.e == 0.296875 and abs(row.j - 1 / 3) < 1e-12


def test_masks(spark):
    cases = [(masking.xify_front, "John Doe", "xxxx xxx"), (masking.credit_card, "4111111111111111", "xxxxxxxxxxxx1111"), (masking.credit_card, "12345", "x2345"), (masking.phone, "+1-555-123-4567", "xx-xxx-xxx-4567"), (masking.email, "user@example.com", "NHCC.BQNU@OYFD.invalid"), (masking.email, "", "DPZD.DZKN@GXWB.invalid")]
    for mask, given, want in cases:
        assert one(spark, mask(F.lit(given))) == want


def test_smart_keys(spark):
    assert one(spark, smartkeys.shard_prefix(F.lit("12345"))) == "12345" and one(spark, smartkeys.smart_value(F.lit("12345"))) == ""
    for key, attr in (("us:12345", "eu"), ("12345", "eu"), ("eu:12345", "")):
        assert not one(spark, smartkeys.validate_vertex(F.lit(key), F.lit(attr), "region")).ok
    assert not one(spark, smartkeys.validate_edge(F.lit("v/eu:1"), F.lit("v/us:2"), True)).ok
    assert one(spark, smartkeys.validate_edge(F.lit("v/eu:1"), F.lit("s/x"), True, ["s"])).ok


def test_plans():
    assert Satellites.assign([f"srv{i}" for i in range(1, 6)], "s", 42) == {"shard": "s42", "leader": "srv1", "followers": ["srv2", "srv3", "srv4", "srv5"]}
    spec = TraversalSpec(24, "g", True, max_depth=3)
    assert TraversalSpec.from_data(spec.to_data()) == spec and spec.kind == "shortest_path"
    with pytest.raises(ValueError):
        TraversalSpec.from_data({"node_type": 99})
    view = PlanNode("view")
    top = PlanNode("limit", PlanNode("sort", view, path="BM25(@doc)", ascending=False), limit=10)
    assert annotate_top_k([top]) == 1 and view.heap == 10
    assert annotate_top_k([PlanNode("limit", PlanNode("filter", top.below), limit=10)]) == 0
    assert FollowerRouter({"a": ["x", "y"]}).route(["a", "b", "a"]) == {"a": "y"}


def test_heap_and_pruning():
    t = Threshold(3)
    [t.add(x) for x in (5, 3, 8)]
    assert t.value == 3 and not t.add(2) and t.add(10) and t.value == 5
    p = Pruned([(1, 8, 10), (2, 9, 10), (3, 1, 2), (4, 1, 3), (5, 10, 11)], Threshold(2))
    assert [d for d, _ in p] == [1, 2, 5] and p.skipped == 2


def simulate(messages):
    last, waiting, applied, duplicates = 0, {}, {}, 0
    for s, payload in messages:
        if s <= last:
            duplicates += 1
            continue
        waiting[s] = payload
        while last + 1 in waiting:
            last += 1
            applied[last] = waiting.pop(last)
    return applied, duplicates, len(waiting)


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_closed_form_of_the_applier(spark, width):
    rnd = random.Random(8)
    logs = {f"s{k}": [(rnd.randint(0, 8), f"p{j}") for j in range(rnd.randint(1, 14))] for k in range(150)}
    df = spark.createDataFrame([(k, j, s, "c", p) for k, log in logs.items() for j, (s, p) in enumerate(log)], "shard string, pos long, sequence long, collection string, payload string")
    done = cdc.apply_closed_form(df, width=width)
    won = {(r.shard, r.sequence): r.payload for r in done.winners.collect()}
    totals = {r.shard: (r.applied, r.duplicates, r.buffered) for r in done.totals.collect()}
    for k, log in logs.items():
        applied, duplicates, buffered = simulate(log)
        assert {s: p for (h, s), p in won.items() if h == k} == applied and totals[k] == (len(applied), duplicates, buffered)


def rows_of(columns, rows):
    def norm(v):
        return repr(round(v, 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(norm, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    if name in registry.ORACLE_SQL:
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = c.sql(registry.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        assert rows_of(columns, got) == rows_of(columns, want.select(*columns).fetchall())
