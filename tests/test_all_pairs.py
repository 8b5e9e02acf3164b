"""Every document meets every item of the benchmark."""

from pyspark.sql import functions as F

from mmspark import registry
from mmspark.functions import similarity


def tables(spark, folder):
    """Three documents, each a copy of an item that document's id modulo the items does not name."""
    items = [(0, "red green blue"), (1, "one two three four"), (2, "north south")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, items[(i + 1) % 3][1]) for i in range(3)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_every_pair(spark, tmp_path):
    sf = tables(spark, tmp_path)
    want = {(i, j): float((i + 1) % 3 == j) for i in range(3) for j in range(3)}
    assert {(r.doc_id, r.item_id): r.jaccard for r in registry.QUERIES["jaccard_exact"](spark, sf).collect()} == want
    found = {(r.doc_id, r.item_id): r.estimate for r in registry.QUERIES["minhash_estimate"](spark, sf).collect()}
    assert found.keys() == want.keys() and {p for p, e in found.items() if e == 1.0} == {p for p, x in want.items() if x}
    assert sum(r.pairs for r in registry.QUERIES["minhash_match"](spark, sf).collect()) == 9


def test_jaccard_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, " \n"), (None, "a b")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.jaccard for r in similarity.jaccard_with_items(docs, [(7, ["b", "c", "b"]), (8, []), (9, None)], rows=2).collect()}
    assert found == {(1, 7): None, (1, 8): None, (1, 9): None, (2, 7): 0.0, (2, 8): 1.0, (2, 9): None, (None, 7): 1 / 3, (None, 8): 0.0, (None, 9): None}
    assert similarity.jaccard_with_items(docs, []).where(F.lit(True)).collect() == []


def test_query_sets_in_blocks(spark):
    docs, items = spark.range(20).select(F.col("id").alias("d")), spark.range(30).select(F.col("id").alias("i"))
    for size in (7, 100):
        assert similarity.with_items(docs, items, "i", size).distinct().count() == 600
        assert sum(b.count() for b in similarity.item_blocks(items, "i", size)) == 30
