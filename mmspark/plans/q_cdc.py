"""Registered change-capture, index, audit, backup and relational queries, each with its DuckDB SQL."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mmspark.operators import cdc, indexing
from mmspark.plans.q_graph import duck_fnv32, table
from mmspark.plans.specs import fresh_enough
from mmspark.sources import audit, backup, frames
from mmspark.sources.folders import shared
from mmspark.streaming import applier

QUERIES: dict = {}
SQL: dict = {}
SATELLITES = ["error"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def wal(spark, sf_dir):
    """The events as a log: the event type is the collection, the user the key."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "REMOVE").otherwise("UPDATE")
    return e.select((F.col("event_id") + 1).alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("event_type").alias("collection"), F.col("user_id").cast("string").alias("key"), op.alias("op"), F.col("props").alias("payload"), F.concat(F.lit("shard_"), (F.col("user_id") % 4).cast("string")).alias("shard"))


_WAL = "w AS (SELECT event_id + 1 AS seq, epoch_us(ts) AS micros, event_type AS collection, user_id::VARCHAR AS key, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'REMOVE' ELSE 'UPDATE' END AS op, props AS payload, 'shard_' || (user_id % 4) AS shard FROM events)"


@query(f"WITH {_WAL} SELECT seq, key, collection FROM w WHERE seq >= 25 AND collection <> 'error' AND {duck_fnv32('key')} % 4 = 1")
def wal_tail_filter(spark, sf_dir):
    info = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(r).alias("replication_factor")) for n, r in (("view", 2), ("click", 1), ("error", 0)))))).select("col.*")
    return cdc.tail(wal(spark, sf_dir), info, 1, 4, 25).select("seq", "key", "collection")


@query(f"WITH {_WAL} SELECT seq, shard, row_number() OVER (PARTITION BY shard ORDER BY seq) AS sequence FROM w")
def wal_sequence(spark, sf_dir):
    return cdc.sequenced(wal(spark, sf_dir), "shard", "seq", 1000).select("seq", "shard", "sequence")


@query(f"WITH {_WAL}, n AS (SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY seq) AS sequence FROM w) SELECT shard, (sequence - 1) // 100 + 1 AS batch, min(sequence) AS first_sequence, max(sequence) AS last_sequence, count(*) AS entries FROM n GROUP BY ALL")
def wal_batches(spark, sf_dir):
    return cdc.batches(wal(spark, sf_dir), "shard", 100, "seq")


_MESSAGES = f"""{_WAL}, n AS (SELECT shard, collection, payload, row_number() OVER (PARTITION BY shard ORDER BY seq) AS s FROM w),
r AS (SELECT shard, s AS sequence, collection, payload, s + (s * 7919) % 13 AS pos, 0 AS again FROM n WHERE s % 50 <> 17 OR s % 100 = 17 UNION ALL SELECT shard, s, collection, payload || '!', s + 40, 1 FROM n WHERE s % 10 = 3),
m AS (SELECT shard, sequence, collection, payload, row_number() OVER (PARTITION BY shard ORDER BY pos, again, sequence) AS pos FROM r)"""


def messages(spark, sf_dir, gaps: bool = True):
    """The log as it reaches the applier: a little out of order, some entries lost, some sent again."""
    n = cdc.sequenced(wal(spark, sf_dir), "shard", "seq", 1000).select("shard", "collection", "payload", F.col("sequence").alias("s"))
    first = n.where("s % 50 <> 17 OR s % 100 = 17") if gaps else n
    # one number that orders by place, copies last, then by sequence: at most 13 first copies come to one place, and one second
    late = (F.col("s") * 7919) % 13
    one = first.select("shard", "s", "collection", "payload", ((F.col("s") + late) * 32 + 12 - late).alias("o"))
    two = n.where("s % 10 = 3").select("shard", "s", "collection", F.concat("payload", F.lit("!")).alias("payload"), ((F.col("s") + 40) * 32 + 16).alias("o"))
    placed = cdc.sequenced(one.unionByName(two), "shard", "o", 1 << 15).withColumnRenamed("sequence", "pos")
    return placed.select("shard", F.col("s").alias("sequence"), "collection", "payload", "pos")


def _applied(source: str) -> str:
    return f"""{source}, f AS (SELECT shard, sequence, min(pos) AS first FROM m GROUP BY ALL), g AS (SELECT *, row_number() OVER o AS rank, max(first) OVER o AS ready FROM f WINDOW o AS (PARTITION BY shard ORDER BY sequence)),
h AS (SELECT *, sequence = rank AS applied, lag(ready) OVER (PARTITION BY shard ORDER BY sequence) AS before FROM g), c AS (SELECT m.*, h.first, h.ready, h.applied, h.before FROM m JOIN h USING (shard, sequence))"""


@query(f"""WITH {_applied(_MESSAGES)}, d AS (SELECT shard, sum(CASE WHEN applied AND pos > ready THEN 1 ELSE 0 END)::BIGINT AS duplicates FROM c GROUP BY shard)
SELECT shard, sum(applied::BIGINT)::BIGINT AS applied, sum((NOT applied)::BIGINT)::BIGINT AS buffered, duplicates, 0::BIGINT AS satellites_skipped FROM h JOIN d USING (shard) GROUP BY shard, duplicates""")
def apply_ooo_dup(spark, sf_dir):
    return cdc.apply_closed_form(messages(spark, sf_dir)).totals


_WIN = "win AS (SELECT shard, sequence, arg_max(payload, pos) AS payload FROM c WHERE applied AND CASE WHEN first <= coalesce(before, -1) THEN pos < before ELSE pos = first END GROUP BY ALL)"


@query(f"WITH {_applied(_MESSAGES)}, {_WIN} SELECT shard, sequence, payload FROM win")
def apply_winners(spark, sf_dir):
    return cdc.apply_closed_form(messages(spark, sf_dir)).winners


@query(f"WITH {_applied(_MESSAGES)}, {_WIN} SELECT shard, sequence, payload FROM win")
def stream_apply_equals_batch(spark, sf_dir):
    """The winners again, through the stateful stream."""
    base = shared(spark, "stream")
    messages(spark, sf_dir).write.mode("overwrite").parquet(f"{base}/in")
    source = spark.readStream.schema("shard string, sequence long, collection string, payload string, pos long").parquet(f"{base}/in")
    q = applier.apply_stream(source).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(applier.OUTPUT).parquet(f"{base}/out").where("kind = 'applied'").select("shard", "sequence", "payload")


@query(f"""WITH {_MESSAGES.replace("WHERE s % 50 <> 17 OR s % 100 = 17", "")}, k AS (SELECT shard, count(DISTINCT sequence) AS applied, count(*) - count(DISTINCT sequence) AS copies FROM m GROUP BY shard) SELECT shard, applied, 0::BIGINT AS buffered, applied AS last_applied FROM k""")
def apply_partition_recovery(spark, sf_dir):
    done = cdc.apply_closed_form(messages(spark, sf_dir, gaps=False))
    last = done.winners.groupBy("shard").agg(F.max("sequence").alias("last_applied"))
    return done.totals.join(last, "shard").select("shard", "applied", "buffered", "last_applied")


@query(f"""WITH {_MESSAGES}, k AS (SELECT shard, sequence, CASE WHEN sequence <= 100 THEN 'REJECT' WHEN sequence > 101 THEN 'OUT_OF_ORDER' ELSE 'ACCEPT' END AS verdict FROM m) SELECT shard, verdict, count(*) AS messages FROM k GROUP BY ALL""")
def idempotency_classify(spark, sf_dir):
    return messages(spark, sf_dir).groupBy("shard", cdc.classify(F.col("sequence"), F.lit(100)).alias("verdict")).agg(F.count("*").alias("messages"))


@query(f"""WITH {_WAL}, n AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY seq) AS sequence FROM w), t AS (SELECT shard, max(sequence) AS cut FROM n WHERE sequence % 500 = 0 GROUP BY shard),
l AS (SELECT n.shard, key, arg_max(op, sequence) AS op, arg_max(payload, sequence) AS payload FROM n LEFT JOIN t USING (shard) WHERE sequence % 500 <> 0 AND sequence > coalesce(cut, -1) GROUP BY ALL) SELECT shard, key, payload FROM l WHERE op <> 'REMOVE'""")
def apply_final_state(spark, sf_dir):
    n = cdc.sequenced(wal(spark, sf_dir), "shard", "seq", 1000).withColumn("op", F.when(F.col("sequence") % 500 == 0, "TRUNCATE").otherwise(F.col("op")))
    return cdc.final_state(n.select("shard", "sequence", "op", "key", "payload"))


_STATES = f"{_WAL}, st AS (SELECT shard, count(*) AS last_generated, count(*) - count(*) // 10 AS last_applied FROM w GROUP BY shard)"


def states(spark, sf_dir):
    n = F.count("*")
    return wal(spark, sf_dir).groupBy("shard").agg(n.alias("last_generated"), (n - F.floor(n / 10)).alias("last_applied"))


@query(f"""WITH {_STATES}, rp AS (SELECT unnest(['shard_0', 'shard_1', 'shard_2', 'shard_3', 'shard_9']) AS shard, unnest([1, 1000000, 1000000, 1, 1]) AS reported)
SELECT shard, CASE WHEN last_generated IS NULL THEN 'unknown shard' WHEN reported <= last_applied THEN 'not ahead of current lastApplied' WHEN reported > last_generated THEN 'exceeds lastGenerated' END AS error, NOT (last_generated IS NULL OR reported > last_generated OR reported <= last_applied) AS ok FROM rp LEFT JOIN st USING (shard)
UNION ALL SELECT shard, NULL, true FROM st""")
def checkpoint_validate(spark, sf_dir):
    st = states(spark, sf_dir)
    told = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(s).alias("shard"), F.lit(r).alias("reported")) for s, r in (("shard_0", 1), ("shard_1", 1000000), ("shard_2", 1000000), ("shard_3", 1), ("shard_9", 1)))))).select("col.*")
    rows = told.unionByName(st.select("shard", F.col("last_generated").alias("reported"))).join(st, "shard", "left")
    return rows.select("shard", cdc.checkpoint_check(F.col("reported"), F.col("last_generated"), F.col("last_applied")).alias("v")).select("shard", "v.ok", "v.error")


@query(f"WITH {_WAL}, f AS (SELECT seq AS sequence, key FROM w WHERE seq > 100 ORDER BY seq LIMIT 50) SELECT sequence, key, (SELECT count(*) FROM w WHERE seq > 100) > 50 AS has_more, (SELECT max(sequence) FROM f) AS last_sequence FROM f")
def feed_page(spark, sf_dir):
    return cdc.feed_page(wal(spark, sf_dir).select(F.col("seq").alias("sequence"), "key"), 100, 50)


@query(f"WITH {_STATES} SELECT count(*) AS shards, sum(last_generated - last_applied)::BIGINT AS pending, floor(max(last_generated - last_applied) * (300 / 150.0))::BIGINT AS lag_estimate FROM st")
def repl_status(spark, sf_dir):
    return cdc.status(states(spark, sf_dir), 300, 150)


@query(f"WITH {_WAL}, x AS (SELECT max(micros) + 20000000 AS now FROM w) SELECT shard, max(micros) AS last_micros, (any_value(now) - max(micros)) / 1e6 AS lag_seconds, (any_value(now) - max(micros)) / 1e6 > 30 AS exceeds FROM w CROSS JOIN x GROUP BY shard")
def repl_lag(spark, sf_dir):
    w = wal(spark, sf_dir)
    return cdc.lag(w, (w.agg(F.max("micros")).first()[0] or 0) + 20_000_000, 30)


@query("WITH k AS (SELECT DISTINCT o_orderkey AS key FROM orders), r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS rn, (SELECT count(*) FROM k) AS m FROM k) SELECT i::INTEGER AS part, key FROM range(1, 8) t(i) JOIN r ON rn = floor(i / 8.0 * m)")
def split_points(spark, sf_dir):
    return indexing.split_points(table(spark, sf_dir, "orders"), "o_orderkey", 8)


@query("SELECT count(*) AS entries, sum(o_custkey)::BIGINT AS carried, 0::BIGINT AS unsorted, 0::BIGINT AS overlapping FROM orders")
def range_build(spark, sf_dir):
    """The build's entries, those that stand behind a larger key of their range, and the ranges that reach into the next."""
    built = indexing.build_sorted(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 8)
    placed = built.select("o_orderkey", "o_custkey", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("o_orderkey").over(Window.partitionBy("part").orderBy("at"))
    ranges = placed.withColumn("back", (before > F.col("o_orderkey")).cast("long")).groupBy("part").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("c"), F.coalesce(F.sum("back"), F.lit(0)).alias("u"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    over = (F.lag("hi").over(Window.orderBy("part")) >= F.col("lo")).cast("long")  # over 8 rows
    return ranges.withColumn("o", F.coalesce(over, F.lit(0))).agg(F.sum("n").alias("entries"), F.sum("c").alias("carried"), F.sum("u").alias("unsorted"), F.sum("o").alias("overlapping"))


@query("""WITH l AS (SELECT o_orderkey AS key, 1 AS pos, 'UPDATE' AS op, 'x' || o_custkey AS value FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 2, 'REMOVE', NULL FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT -o_orderkey, 3, 'INSERT', 'n' FROM orders WHERE o_orderkey % 10 = 1),
w AS (SELECT key, arg_max(op, pos) AS op, max(pos) AS pos FROM l GROUP BY key), v AS (SELECT w.key, w.op, l.value FROM w JOIN l USING (key, pos)), i AS (SELECT o_orderkey AS key, o_orderstatus AS value FROM orders)
SELECT coalesce(i.key, v.key) AS key, CASE WHEN v.key IS NULL THEN i.value ELSE v.value END AS value FROM i FULL JOIN v ON i.key = v.key WHERE coalesce(v.op, '') <> 'REMOVE'""")
def changelog_apply(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey", F.col("o_orderstatus").alias("value"))
    log = o.where("key % 3 = 0").select("key", F.lit(1).alias("pos"), F.lit("UPDATE").alias("op"), F.concat(F.lit("x"), F.col("o_custkey").cast("string")).alias("value"))
    log = log.unionByName(o.where("key % 6 = 0").select("key", F.lit(2).alias("pos"), F.lit("REMOVE").alias("op"), F.lit(None).cast("string").alias("value")))
    log = log.unionByName(o.where("key % 10 = 1").select((-F.col("key")).alias("key"), F.lit(3).alias("pos"), F.lit("INSERT").alias("op"), F.lit("n").alias("value")))
    return indexing.apply_changelog(o.select("key", "value"), log, "key")


@query(f"WITH {_WAL} SELECT collection AS topic, key AS username, count(*) AS events, min(payload || '|x') AS first_text FROM w GROUP BY ALL")
def audit_format_parse(spark, sf_dir):
    w = wal(spark, sf_dir)
    line = audit.format_line(F.col("micros"), F.lit("server"), F.col("collection"), F.col("key"), F.lit("_system"), F.lit("127.0.0.1"), F.lit("basic"), F.concat("payload", F.lit("|x")))
    parsed = audit.parse_lines(w.select(line.alias("value")))
    return parsed.groupBy("topic", "username").agg(F.count("*").alias("events"), F.min("text").alias("first_text"))


_SAVED = ("customer", "lineitem", "nation", "orders", "region")


@query("SELECT t AS name, n AS rows_back, true AS is_consistent FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in _SAVED) + ")")
def backup_manifest(spark, sf_dir):
    """Copy tables, list the manifest and read the copies back."""
    base = shared(spark, "backup")
    done = backup.create(spark, base, {t: table(spark, sf_dir, t) for t in _SAVED}, 12345, "nightly")
    back = backup.restore(spark, base, done.backupId)
    counts = [back[t].agg(F.count("*").alias("rows_back")).select(F.lit(t).alias("name"), "rows_back") for t in sorted(back)]
    flags = backup.listing(spark, base).select("isConsistent", F.explode("collections").alias("name"))
    return reduce(DataFrame.unionByName, counts).join(flags, "name").select("name", "rows_back", F.col("isConsistent").alias("is_consistent"))


@query("SELECT o_custkey % 3000 <= 1000 AS bounded, false AS never, count(*) AS reads FROM orders GROUP BY ALL")
def staleness_eligible(spark, sf_dir):
    lag_ms = F.col("o_custkey") % 3000
    return table(spark, sf_dir, "orders").groupBy(fresh_enough(lag_ms, 1000).alias("bounded"), fresh_enough(lag_ms, 0).alias("never")).agg(F.count("*").alias("reads"))


@query("SELECT event_id, lower(hex(encode(props))) AS payload, strlen(props)::BIGINT + 4 AS consumed FROM events")
def frame_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", frames.parse(frames.frame(F.encode(F.col("props"), "UTF-8"))).alias("p"))
    return e.select("event_id", F.lower(F.hex("p.payload")).alias("payload"), F.col("p.consumed").cast("long").alias("consumed"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS orders FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def filter_aggregate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("orders"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def sort_limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def window_tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total"))
    return e.select(F.col("window.start").alias("start"), "event_type", "events", "total")
