"""Connected components on edge tables, without collecting anything."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mmspark.llm._spark import Steps, join_spread


def components(edges: DataFrame, steps: Steps | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (columns a, b).

    Each round hooks every node to its smallest neighbour, follows these
    pointers to their ends (doubling the reach each time) and contracts the
    edges, so the number of nodes at least halves; the smallest node of a
    component always keeps its own label.  A node with very many neighbours is
    dealt to several tasks.  The result is a step of `steps`.
    """
    steps = steps or Steps(edges.sparkSession)
    edges = steps.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        last = steps.keep(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")))
        up = last
        while True:
            hop = steps.keep(join_spread(up, up.select(F.col("node").alias("up"), F.col("up").alias("next")), "up", "node").select("node", "up", "next"))
            steps.drop(last)
            last, up = hop, hop.select("node", F.col("next").alias("up"))
            if hop.where("next <> up").isEmpty():
                break
        before = found
        if before is None:
            found = steps.keep(up)
        else:
            found = steps.keep(join_spread(before, up.select(F.col("node").alias("up"), F.col("up").alias("now")), "up", "node", "left").select("node", F.coalesce("now", "up").alias("up")))
            steps.drop(before)
        left = up.select(F.col("node").alias("a"), F.col("up").alias("x"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        one = join_spread(edges, left, "a", "b")
        both = join_spread(one, right, "b", "a", counted=edges)
        older, edges = edges, steps.keep(both.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        steps.drop(older, last)
    if found is None:
        found = edges.select(F.col("a").alias("node"), F.col("b").alias("up"))
    else:
        steps.drop(edges)
    return steps.keep(found.select("node", F.col("up").alias("component")))
