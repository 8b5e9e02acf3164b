"""Traversals, path enumeration and shortest paths by unrolled frontier joins.

Paths never visit a vertex twice.  Each hop is one equi-join of the frontier
with the edges.  The edges of a disjoint graph are stored by prefix (``write_edges``), and
a traversal from a known start reads the partition of its prefix only.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mmspark.functions.smartkeys import step_prefix
from mmspark.sources.folders import stored

DIRECTIONS = ("OUTBOUND", "INBOUND", "ANY")


def write_edges(edges: DataFrame, path: str) -> DataFrame:
    """Store the edges (_from, _to, ...) within a prefix by `smart_prefix`; edges between prefixes don't belong to a disjoint graph and are left out."""
    rows = edges.withColumn("smart_prefix", step_prefix(F.col("_from"))).where(F.col("smart_prefix") == step_prefix(F.col("_to")))
    rows.repartition("smart_prefix", F.pmod(F.xxhash64("_from"), F.lit(16))).write.partitionBy("smart_prefix").parquet(path)
    return edges.sparkSession.read.schema(rows.schema).parquet(path)


def prefix_of(handle: str) -> str:
    return (handle.partition("/")[2] or handle).partition(":")[0]


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst) of the edges (_from, _to) in a direction."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction: {direction}")
    out = edges.select(F.col("_from").alias("src"), F.col("_to").alias("dst"))
    back = edges.select(F.col("_to").alias("src"), F.col("_from").alias("dst"))
    return {"OUTBOUND": out, "INBOUND": back, "ANY": out.unionByName(back).distinct()}[direction]


def paths(edges: DataFrame, start: str, min_depth: int, max_depth: int, direction: str = "OUTBOUND", disjoint: bool = False) -> DataFrame:
    """(vertex, depth, path) of every path from the start."""
    spark = edges.sparkSession
    if disjoint and "smart_prefix" in edges.columns:
        edges = edges.where(F.col("smart_prefix") == prefix_of(start))
    steps = oriented(edges, direction)
    if disjoint:
        steps = steps.where((step_prefix(F.col("src")) == prefix_of(start)) & (step_prefix(F.col("dst")) == prefix_of(start)))
    frontier = spark.range(1).select(F.lit(start).alias("vertex"), F.lit(0).alias("depth"), F.array(F.lit(start)).alias("path"))
    found = [frontier] if min_depth == 0 else []
    for d in range(1, max_depth + 1):
        nxt = frontier.join(steps, frontier["vertex"] == steps["src"]).where(~F.array_contains("path", F.col("dst")))
        frontier = nxt.select(F.col("dst").alias("vertex"), F.lit(d).alias("depth"), F.array_append("path", F.col("dst")).alias("path"))
        if d >= min_depth:
            found.append(frontier)
    out = found[0] if found else frontier.limit(0)
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def smart_hop(frontier: DataFrame, steps: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """One hop of (vertex, depth, path) as the shard of a prefix takes it: (its own vertices' next steps, the others, which wait for their shards).

    `steps` are (src, dst); only those of the prefix are read.  A vertex without a handle waits.
    """
    local = F.coalesce(step_prefix(F.col("vertex")) == prefix, F.lit(False))
    own = steps.where(step_prefix(F.col("src")) == prefix)
    grown = frontier.where(local).join(own, F.col("vertex") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
    return grown.select(F.col("dst").alias("vertex"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("dst")).alias("path")), frontier.where(~local)


def enumerate_paths(edges: DataFrame, start: str, target: str, min_depth: int, max_depth: int, direction: str = "OUTBOUND") -> DataFrame:
    """The paths that end at the target."""
    return paths(edges, start, min_depth, max_depth, direction).where(F.col("vertex") == target)


def shortest_path(edges: DataFrame, start: str, target: str, max_depth: int = 8, direction: str = "OUTBOUND") -> DataFrame:
    """One row (depth, path): the shortest path, the first of its kind by its vertices; none if there is none.

    Breadth first; each vertex keeps its least path only, and visited vertices
    leave by an anti-join.
    """
    spark = edges.sparkSession
    steps = oriented(edges, direction)
    visited = frontier = spark.range(1).select(F.lit(start).alias("vertex"), F.array(F.lit(start)).alias("path"))
    for d in range(max_depth + 1):
        hit = frontier.where(F.col("vertex") == target)
        if d == max_depth or not hit.isEmpty():
            return hit.select(F.lit(d).alias("depth"), "path")
        grown = frontier.join(steps, frontier["vertex"] == steps["src"]).select(F.col("dst").alias("vertex"), F.array_append("path", F.col("dst")).alias("path"))
        # written, so that a hop reads the one before it and not the whole search
        frontier = stored(grown.join(visited.select("vertex"), "vertex", "left_anti").groupBy("vertex").agg(F.min("path").alias("path")), "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited.limit(0).select(F.lit(0).alias("depth"), "path")
