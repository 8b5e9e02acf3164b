"""Registered graph queries, each with its DuckDB SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mmspark.functions import smartkeys as K
from mmspark.operators import traversal as V
from mmspark.plans.specs import Satellites
from mmspark.sources.folders import shared, stored

QUERIES: dict = {}
SQL: dict = {}
SHARDS = 4
START = "customer/AMERICA:1"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, n_name, r_name), joined as satellites."""
    sats = Satellites()
    sats.register("region")
    return sats.join(table(spark, sf_dir, "nation"), "region", table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def vertices(spark: SparkSession, sf_dir: str, name: str, key: str, nation: str) -> DataFrame:
    sats = Satellites()
    sats.register("nation")
    rows = sats.join(table(spark, sf_dir, name).select(key, nation), "nation", places(spark, sf_dir), F.col(nation) == F.col("n_nationkey"))
    return rows.select(F.col(key).alias("id"), "r_name", "n_name", K.smart_key(F.col("r_name"), F.col(key).cast("string")).alias("key"))


def customers(spark, sf_dir):
    return vertices(spark, sf_dir, "customer", "c_custkey", "c_nationkey")


def suppliers(spark, sf_dir):
    return vertices(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(_key, _from, _to, from_key, to_key) of the distinct customer-supplier pairs."""
    pairs = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct()
    c = customers(spark, sf_dir).select(F.col("id").alias("o_custkey"), F.col("r_name").alias("fr"), F.col("key").alias("from_key"))
    s = suppliers(spark, sf_dir).select(F.col("id").alias("l_suppkey"), F.col("r_name").alias("tr"), F.col("key").alias("to_key"))
    rows = pairs.join(c, "o_custkey").join(s, "l_suppkey")
    local = F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    return rows.select(K.smart_edge_key(F.col("fr"), F.col("tr"), local).alias("_key"), F.concat(F.lit("customer/"), "from_key").alias("_from"), F.concat(F.lit("supplier/"), "to_key").alias("_to"), "from_key", "to_key")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade edges, then supplier to nation, then nation to region."""
    s = suppliers(spark, sf_dir).select(F.concat(F.lit("supplier/"), "key").alias("_from"), F.concat(F.lit("nation/"), "n_name").alias("_to"))
    n = places(spark, sf_dir).select(F.concat(F.lit("nation/"), "n_name").alias("_from"), F.concat(F.lit("region/"), "r_name").alias("_to"))
    return trade(spark, sf_dir).select("_from", "_to").unionByName(s).unionByName(n)


def duck_fnv32(e: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, strlen({e})), lambda i: ('0x' || substr(hex(encode({e})), 2 * i + 1, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"


C_SQL = "c AS (SELECT c_custkey AS id, r_name, n_name, r_name || ':' || c_custkey AS key FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
S_SQL = "s AS (SELECT s_suppkey AS id, r_name, n_name, r_name || ':' || s_suppkey AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
T_SQL = f"""{C_SQL}, {S_SQL}, p AS (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
t AS (SELECT c.r_name || ':' || s.r_name || ':' || o_custkey || '-' || l_suppkey AS _key, 'customer/' || c.key AS _from, 'supplier/' || s.key AS _to, c.key AS from_key, s.key AS to_key
  FROM p JOIN c ON c.id = o_custkey JOIN s ON s.id = l_suppkey)"""
E_SQL = f"""{T_SQL}, e AS (SELECT _from, _to FROM t UNION ALL SELECT 'supplier/' || key, 'nation/' || n_name FROM s
  UNION ALL SELECT 'nation/' || n_name, 'region/' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def walk_sql(steps: str, depth: int, start: str = START) -> str:
    return f"""w AS (SELECT '{start}' AS vertex, 0 AS depth, ['{start}'] AS path
  UNION ALL SELECT dst, depth + 1, list_append(path, dst) FROM w JOIN {steps} ON src = vertex WHERE depth < {depth} AND NOT list_contains(path, dst))"""


_shard = lambda e: f"({duck_fnv32(e)} % {SHARDS})::INTEGER"


@query(f"WITH {C_SQL}, k AS (SELECT split_part(key, ':', 1) AS p, {_shard('split_part(key, chr(58), 1)')} AS i FROM c) SELECT 'customer_s' || i AS shard, p AS prefix, count(*) AS customers FROM k GROUP BY ALL")
def smart_shard_of_customer(spark, sf_dir):
    c = customers(spark, sf_dir)
    shard = K.shard_name(F.lit("customer"), K.responsible_shard(F.col("key"), SHARDS))
    return c.groupBy(shard.alias("shard"), K.shard_prefix(F.col("key")).alias("prefix")).agg(F.count("*").alias("customers"))


@query(f"WITH {T_SQL}, k AS (SELECT {_shard('split_part(_key, chr(58), 1)')} AS i FROM t) SELECT i AS smart_edge, i AS edge_compat, count(*) AS edges FROM k GROUP BY ALL")
def edge_shard_strategy(spark, sf_dir):
    e = trade(spark, sf_dir)
    return e.groupBy(K.responsible_shard(F.col("_key"), SHARDS, K.STRATEGIES[0]).alias("smart_edge"), K.responsible_shard(F.col("_key"), SHARDS, K.STRATEGIES[2]).alias("edge_compat")).agg(F.count("*").alias("edges"))


@query(f"""WITH {C_SQL}, k AS (SELECT id, CASE id % 4 WHEN 1 THEN id::VARCHAR ELSE key END AS key, CASE id % 4 WHEN 2 THEN NULL WHEN 3 THEN 'EUROPE' ELSE r_name END AS attr FROM c),
v AS (SELECT id, CASE WHEN attr IS NULL OR attr = '' THEN 'smart graph attribute ''region'' is missing' WHEN instr(key, ':') = 0 THEN 'key has no smart prefix'
  WHEN split_part(key, ':', 1) <> attr THEN 'key prefix differs from attribute ''region''' END AS error FROM k) SELECT id, error IS NULL AS ok, error FROM v""")
def validate_vertices(spark, sf_dir):
    c, kind = customers(spark, sf_dir), F.col("id") % 4
    key = F.when(kind == 1, F.col("id").cast("string")).otherwise(F.col("key"))
    attr = F.when(kind == 2, F.lit(None)).when(kind == 3, F.lit("EUROPE")).otherwise(F.col("r_name"))
    return c.select("id", K.validate_vertex(key, attr, "region").alias("v")).select("id", "v.ok", "v.error")


@query(f"WITH {T_SQL}, k AS (SELECT split_part(from_key, ':', 1) = split_part(to_key, ':', 1) AS ok FROM t) SELECT ok, CASE WHEN NOT ok THEN 'edge crosses prefixes of a disjoint graph' END AS error, count(*) AS edges FROM k GROUP BY ALL")
def validate_edges_disjoint(spark, sf_dir):
    e = trade(spark, sf_dir).select(K.validate_edge(F.col("_from"), F.col("_to"), True).alias("v"))
    return e.groupBy("v.ok", "v.error").agg(F.count("*").alias("edges"))


@query(f"WITH {T_SQL} SELECT true AS ok, true AS smart_to_satellite, count(*) AS edges FROM t")
def validate_edges_satellite(spark, sf_dir):
    e = trade(spark, sf_dir).select(K.validate_edge(F.col("_from"), F.col("_to"), True, ["supplier"])["ok"].alias("ok"), K.is_smart_to_satellite(F.col("_from"), F.col("_to"), ["supplier"]).alias("smart_to_satellite"))
    return e.groupBy("ok", "smart_to_satellite").agg(F.count("*").alias("edges"))


@query(f"""WITH {T_SQL}, k AS (SELECT {_shard('split_part(from_key, chr(58), 1)')} AS a, {_shard('split_part(to_key, chr(58), 1)')} AS b FROM t),
u AS (SELECT a AS shard, CASE WHEN a = b THEN 'local' ELSE 'from' END AS edge_part FROM k UNION ALL SELECT b, 'to' FROM k WHERE a <> b) SELECT shard, edge_part, count(*) AS edges FROM u GROUP BY ALL""")
def edge_parts_union(spark, sf_dir):
    e = trade(spark, sf_dir).select(K.responsible_shard(F.col("from_key"), SHARDS).alias("a"), K.responsible_shard(F.col("to_key"), SHARDS).alias("b"))
    rows = e.withColumn("shard", F.explode(F.array_distinct(F.array("a", "b"))))
    return rows.groupBy("shard", K.edge_part(F.col("a"), F.col("b"), F.col("shard")).alias("edge_part")).agg(F.count("*").alias("edges"))


@query(f"""WITH {C_SQL}, k AS (SELECT 'customer_s' || {_shard('split_part(key, chr(58), 1)')} AS shard, split_part(key, ':', 1) AS prefix FROM c)
SELECT prefix, shard = 'customer_s1' AS is_local, false AS unknown_is_local, count(*) AS customers FROM k GROUP BY ALL""")
def locality_check(spark, sf_dir):
    c = customers(spark, sf_dir).select(F.concat(F.lit("customer/"), "key").alias("_id"), K.shard_name(F.lit("customer"), K.responsible_shard(F.col("key"), SHARDS)).alias("shard"))
    mapping = {"customer": "customer_s1"}
    name = K.collection_of(F.col("_id"), False)
    return c.groupBy(K.step_prefix(F.col("_id")).alias("prefix"), K.is_responsible(name, F.col("shard"), mapping).alias("is_local"), K.is_responsible(F.lit("other"), F.col("shard"), mapping).alias("unknown_is_local")).agg(F.count("*").alias("customers"))


@query(f"WITH {T_SQL} SELECT split_part(from_key, ':', 1) AS prefix, split_part(from_key, ':', 1) = split_part(to_key, ':', 1) AS valid, count(*) AS edges FROM t GROUP BY ALL")
def disjoint_path_check(spark, sf_dir):
    e = trade(spark, sf_dir)
    return e.groupBy(K.shard_prefix(F.col("from_key")).alias("prefix"), K.valid_disjoint_path(F.col("from_key"), F.col("to_key")).alias("valid")).agg(F.count("*").alias("edges"))


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def satellite_join(spark, sf_dir):
    sats = Satellites()
    sats.register("nation")
    rows = sats.join(table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal"), "nation", places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def _start(spark, sf_dir) -> str:
    """The customer with the smallest key."""
    row = customers(spark, sf_dir).orderBy("id").select("key").first()
    return f"customer/{row[0]}"


def _sql_from_start(steps: str, depth: int) -> str:
    return walk_sql(steps, depth).replace(f"'{START}' AS vertex, 0 AS depth, ['{START}'] AS path", "'customer/' || (SELECT key FROM c ORDER BY id LIMIT 1) AS vertex, 0 AS depth, ['customer/' || (SELECT key FROM c ORDER BY id LIMIT 1)] AS path")


@query(f"WITH RECURSIVE {E_SQL}, st AS (SELECT _from AS src, _to AS dst FROM e), {_sql_from_start('st', 3)} SELECT vertex, depth, array_to_string(path, '>') AS path FROM w WHERE depth >= 1")
def traverse_out_1_3(spark, sf_dir):
    return V.paths(stored(chain(spark, sf_dir).select("_from", "_to"), "edges"), _start(spark, sf_dir), 1, 3).select("vertex", "depth", F.array_join("path", ">").alias("path"))


@query(f"WITH RECURSIVE {E_SQL}, st AS (SELECT _from AS src, _to AS dst FROM t UNION SELECT _to, _from FROM t), {_sql_from_start('st', 2)} SELECT vertex, depth, count(*) AS paths FROM w GROUP BY ALL")
def traverse_any_2(spark, sf_dir):
    return V.paths(stored(trade(spark, sf_dir).select("_from", "_to"), "edges"), _start(spark, sf_dir), 0, 2, "ANY").groupBy("vertex", "depth").agg(F.count("*").alias("paths"))


@query(f"""WITH RECURSIVE {E_SQL}, st AS (SELECT _from AS src, _to AS dst FROM t UNION SELECT _to, _from FROM t), {_sql_from_start('st', 2)}, h AS (SELECT split_part(split_part((SELECT vertex FROM w WHERE depth = 0), '/', 2), ':', 1) AS here)
SELECT 'expanded' AS step, vertex, count(*) AS paths FROM w, h WHERE depth = 2 AND split_part(split_part(path[2], '/', 2), ':', 1) = here GROUP BY ALL UNION ALL SELECT 'queued', vertex, count(*) FROM w, h WHERE depth = 1 AND split_part(split_part(vertex, '/', 2), ':', 1) <> here GROUP BY ALL""")
def smart_dispatch(spark, sf_dir):
    """The second hop at the start's shard: what it expands itself, and what it leaves to other shards."""
    edges, start = stored(trade(spark, sf_dir).select("_from", "_to"), "edges"), _start(spark, sf_dir)
    expanded, queued = V.smart_hop(V.paths(edges, start, 1, 1, "ANY"), V.oriented(edges, "ANY"), V.prefix_of(start))
    named = lambda df, step: df.groupBy("vertex").agg(F.count("*").alias("paths")).select(F.lit(step).alias("step"), "vertex", "paths")
    return named(expanded, "expanded").unionByName(named(queued, "queued"))


@query(f"WITH RECURSIVE {E_SQL}, st AS (SELECT _from AS src, _to AS dst FROM e), {_sql_from_start('st', 3)} SELECT depth, array_to_string(path, '>') AS path FROM w WHERE vertex = 'region/ASIA'")
def enumerate_paths(spark, sf_dir):
    return V.enumerate_paths(stored(chain(spark, sf_dir).select("_from", "_to"), "edges"), _start(spark, sf_dir), "region/ASIA", 1, 3).select("depth", F.array_join("path", ">").alias("path"))


@query(f"WITH RECURSIVE {E_SQL}, st AS (SELECT _from AS src, _to AS dst FROM e), {_sql_from_start('st', 3)} SELECT depth, array_to_string(path, '>') AS path FROM w WHERE vertex = 'region/EUROPE' ORDER BY w.depth, w.path LIMIT 1")
def shortest_path(spark, sf_dir):
    return V.shortest_path(stored(chain(spark, sf_dir).select("_from", "_to"), "edges"), _start(spark, sf_dir), "region/EUROPE", 4).select("depth", F.array_join("path", ">").alias("path"))


@query(f"WITH RECURSIVE {T_SQL}, st AS (SELECT _from AS src, _to AS dst FROM t WHERE split_part(from_key, ':', 1) = split_part(to_key, ':', 1) UNION SELECT _to, _from FROM t WHERE split_part(from_key, ':', 1) = split_part(to_key, ':', 1)), {_sql_from_start('st', 2)} SELECT vertex, depth, count(*) AS paths FROM w WHERE depth >= 1 GROUP BY ALL")
def traverse_disjoint_local(spark, sf_dir):
    return V.paths(V.write_edges(trade(spark, sf_dir).select("_from", "_to"), shared(spark, "edges")), _start(spark, sf_dir), 1, 2, "ANY", disjoint=True).groupBy("vertex", "depth").agg(F.count("*").alias("paths"))
