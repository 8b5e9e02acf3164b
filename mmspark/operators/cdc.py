"""Change capture: tailing, sequencing, batching, idempotent apply, lag, status, feed."""

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mmspark.functions.hashing import fnv1a32


def tail(wal: DataFrame, collections: DataFrame, shard: int, shards: int, seek: int = 0) -> DataFrame:
    """Entries from a position on that belong to a shard: satellites are dropped, the whole key is hashed, an unknown collection is no satellite."""
    known = collections.select(F.col("name").alias("collection"), F.col("replication_factor").alias("rf"))
    rows = wal.where(F.col("seq") >= seek).join(known, "collection", "left").where(F.coalesce(F.col("rf") != 0, F.lit(True))).drop("rf")
    return rows.where(F.pmod(fnv1a32(F.col("key")), F.lit(shards)) == shard) if shards > 1 else rows


def poll(wal: DataFrame, limit: int) -> DataFrame:
    """The first entries by position."""
    return wal.orderBy("seq").limit(limit)


def sequenced(rows: DataFrame, shard: str, order: str, width: int = 1 << 16) -> DataFrame:
    """Add `sequence`: 1, 2, 3 ... by `order` (a unique long) within each shard.

    Numbers are counted inside ranges of `width` positions and moved up by the
    counts of the ranges before, so a hot shard is not one task.
    """
    cell = F.floor(F.col(order) / width)
    rows = rows.withColumn("__cell", cell)
    counts = rows.groupBy(shard, "__cell").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(shard).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(shard, "__cell", F.coalesce(before, F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy(shard, "__cell").orderBy(order))
    return rows.withColumn("__local", local).join(offsets, [shard, "__cell"]).withColumn("sequence", (F.col("__before") + F.col("__local")).cast("long")).drop("__cell", "__local", "__before")


def batches(rows: DataFrame, shard: str, size: int, order: str) -> DataFrame:
    """One row a batch of a shard: batch, first and last sequence, entries; the last one may be short."""
    numbered = sequenced(rows, shard, order).withColumn("batch", F.floor((F.col("sequence") - 1) / size).cast("long") + 1)
    return numbered.groupBy(shard, "batch").agg(F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.count("*").alias("entries"))


def classify(sequence: Column, last: Column) -> Column:
    """Accept the next one, reject what was applied, else out of order."""
    return F.when(sequence <= last, "REJECT").when(sequence > last + 1, "OUT_OF_ORDER").otherwise("ACCEPT")


@dataclass
class Applied:
    """winners: the message that was applied for each sequence; totals: a row a shard."""

    winners: DataFrame
    totals: DataFrame


def _arrivals(first: DataFrame, width: int) -> DataFrame:
    """Add to (shard, sequence, first): `rank` in the shard, `at` and `before`, the largest first arrivals up to a sequence and before it.

    Like `sequenced`: inside ranges of `width` sequences, then with what the ranges before them hold.
    """
    rows = first.withColumn("cell", F.floor(F.col("sequence") / width))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"), F.max("first").alias("most"))
    cells = cells.select("shard", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.max("most").over(earlier).alias("most"))
    inside = Window.partitionBy("shard", "cell").orderBy("sequence")
    local = rows.select("*", F.row_number().over(inside).alias("rn"), F.max("first").over(inside).alias("here"), F.max("first").over(inside.rowsBetween(Window.unboundedPreceding, -1)).alias("there"))
    return local.join(cells, ["shard", "cell"]).select("shard", "sequence", "first", (F.col("n") + F.col("rn")).alias("rank"), F.greatest("most", "here").alias("at"), F.greatest("most", "there").alias("before"))


def apply_closed_form(messages: DataFrame, satellites: list[str] = (), width: int = 1 << 16) -> Applied:
    """What the idempotent applier does with messages (shard, pos, sequence, collection, payload) in the order of pos.

    Sequences apply in order; one that comes early waits, and a later copy
    replaces it while it waits.  A sequence is applied at the moment its last
    predecessor arrives, the running maximum of first arrivals, which is taken in
    ranges of `width` sequences, so a hot shard is not one task.
    """
    skipped = F.col("collection").isin(*satellites) if satellites else F.lit(False)
    live = messages.where(~skipped)
    first = live.where("sequence > 0").groupBy("shard", "sequence").agg(F.min("pos").alias("first"))
    known = _arrivals(first, width).withColumn("applied", F.col("sequence") == F.col("rank"))
    copies = live.join(known, ["shard", "sequence"], "left")
    waiting = F.col("first") <= F.coalesce("before", F.lit(-1))
    candidate = copies.where("applied").where(F.when(waiting, F.col("pos") < F.col("before")).otherwise(F.col("pos") == F.col("first")))
    winners = candidate.groupBy("shard", "sequence").agg(F.max_by("payload", "pos").alias("payload"))
    duplicate = (F.col("sequence") <= 0) | (F.coalesce("applied", F.lit(False)) & (F.col("pos") > F.col("at")))
    totals = messages.select("shard").distinct()
    parts = (
        known.groupBy("shard").agg(F.sum(F.col("applied").cast("long")).alias("applied"), F.sum((~F.col("applied")).cast("long")).alias("buffered")),
        copies.groupBy("shard").agg(F.sum(duplicate.cast("long")).alias("duplicates")),
        messages.groupBy("shard").agg(F.sum(skipped.cast("long")).alias("satellites_skipped")),
    )
    for p in parts:
        totals = totals.join(p, "shard", "left")
    return Applied(winners, totals.fillna(0))


def final_state(log: DataFrame) -> DataFrame:
    """(shard, key, payload) after a log (shard, sequence, op, key, payload): the last writer after the last truncate, unless it removes."""
    cut = log.where("op = 'TRUNCATE'").groupBy("shard").agg(F.max("sequence").alias("cut"))
    rows = log.where("op <> 'TRUNCATE'").join(cut, "shard", "left").where(F.col("sequence") > F.coalesce("cut", F.lit(-1)))
    last = rows.groupBy("shard", "key").agg(F.max_by(F.struct("op", "payload"), "sequence").alias("w"))
    return last.where("w.op <> 'REMOVE'").select("shard", "key", F.col("w.payload").alias("payload"))


def checkpoint_check(reported: Column, generated: Column, applied: Column) -> Column:
    """struct(ok, error) of a reported checkpoint; a shard without a state, or with nothing generated and applied, is unknown."""
    unknown = generated.isNull() | ((generated == 0) & (applied == 0))
    error = F.when(unknown, "unknown shard").when(reported <= applied, "not ahead of current lastApplied").when(reported > generated, "exceeds lastGenerated")
    return F.struct(error.isNull().alias("ok"), error.alias("error"))


def feed_page(feed: DataFrame, after: int, limit: int = 0) -> DataFrame:
    """One page (rows ordered by sequence) with has_more and last_sequence on every row; 0 asks for 1000, 10000 at most."""
    n = min(limit or 1000, 10_000)
    page = feed.where(F.col("sequence") > after).orderBy("sequence").limit(n + 1)
    ranked = page.withColumn("rn", F.row_number().over(Window.orderBy("sequence")))  # over n + 1 rows at most
    tail_ = ranked.agg((F.count("*") > n).alias("has_more"), F.coalesce(F.max(F.when(F.col("rn") <= n, F.col("sequence"))), F.lit(after)).alias("last_sequence"))
    return ranked.where(F.col("rn") <= n).drop("rn").crossJoin(F.broadcast(tail_))


def lag_estimate(most: Column, sent: int, acked: int) -> Column:
    """The largest backlog, times sent over acknowledged messages where both are known."""
    share = F.lit(sent / acked) if sent > 0 and acked > 0 else F.lit(1.0)
    return F.when(most > 0, most * share).otherwise(F.lit(0.0))


def status(states: DataFrame, sent: int, acked: int) -> DataFrame:
    """Totals over shard states (shard, last_generated, last_applied), and the lag estimate."""
    pending = F.greatest(F.col("last_generated") - F.col("last_applied"), F.lit(0))
    total = states.agg(F.count("*").alias("shards"), F.sum(pending).alias("pending"), F.max(pending).alias("most"))
    return total.select("shards", "pending", F.floor(lag_estimate(F.col("most"), sent, acked)).cast("long").alias("lag_estimate"))


def status_report(states: DataFrame, running: bool, sent: int, acked: int) -> dict:
    """The whole status of a replication: a row a shard (shards are few), totals, lag."""
    pending = F.greatest(F.col("last_generated") - F.col("last_applied"), F.lit(0))
    rows = states.select("shard", "last_generated", "last_applied", pending.alias("pending")).orderBy("shard").collect()
    most = max((r["pending"] for r in rows), default=0)
    lag_ = float(most) * (sent / acked if sent > 0 and acked > 0 else 1.0)
    shards = [{"shardId": r["shard"], "lastGenerated": r["last_generated"], "lastApplied": r["last_applied"], "pending": r["pending"]} for r in rows]
    return {"isRunning": running, "lagSeconds": lag_, "totalMessagesSent": sent, "totalMessagesAcked": acked, "totalPending": sum(r["pending"] for r in rows), "shardStates": shards}


def lag(entries: DataFrame, now_micros: int, limit_seconds: float) -> DataFrame:
    """Per shard: the last entry's time, the lag in seconds, and whether it exceeds the limit."""
    seconds = (F.lit(now_micros) - F.col("last_micros")) / 1e6
    return entries.groupBy("shard").agg(F.max("micros").alias("last_micros")).select("shard", "last_micros", seconds.alias("lag_seconds"), (seconds > limit_seconds).alias("exceeds"))


@dataclass
class Control:
    """The service of a replication: each route answers with an envelope of error, code and result.

    `states` holds generated and applied sequences by shard, `feeds` the messages of
    each shard as a DataFrame (sequence, ...), `clock` the seconds of an answer.
    """

    running: bool = False
    states: dict[str, dict[str, int]] = field(default_factory=dict)
    feeds: dict[str, DataFrame] = field(default_factory=dict)
    sent: int = 0
    acked: int = 0
    clock: Callable[[], float] = time.time
    ROUTES = ("status", "start", "stop", "reset", "feed", "checkpoint")

    @staticmethod
    def _done(**result) -> dict:
        return {"error": False, "code": 200, "result": result}

    @staticmethod
    def _failed(code: int, message: str) -> dict:
        return {"error": True, "code": code, "errorMessage": message}

    def route(self, name: str, **given) -> dict:
        return getattr(self, name)(**given) if name in self.ROUTES else self._failed(404, f"unknown route: {name}")

    def status(self) -> dict:
        pending = {k: max(0, v["generated"] - v["applied"]) for k, v in self.states.items()}
        most = max(pending.values(), default=0)
        shards = [{"shardId": k, "lastGenerated": v["generated"], "lastApplied": v["applied"], "pending": pending[k]} for k, v in sorted(self.states.items())]
        ratio = self.sent / self.acked if self.sent > 0 and self.acked > 0 else 1.0
        return self._done(isRunning=self.running, lagSeconds=most * ratio, totalMessagesSent=self.sent, totalMessagesAcked=self.acked, totalPending=sum(pending.values()), shardStates=shards)

    def start(self) -> dict:
        if self.running:
            return self._failed(409, "replication is already running")
        self.running = True
        return self._done(started=True, timestamp=int(self.clock()), previousState="stopped")

    def stop(self) -> dict:
        if not self.running:
            return self._failed(409, "replication is not running")
        self.running = False
        return self._done(stopped=True, timestamp=int(self.clock()), previousState="running")

    def reset(self) -> dict:
        n = len(self.states)
        self.states.clear()
        return self._done(reset=True, shardsReset=n)

    def feed(self, shard: str = "", after: int = 0, limit: int = 0) -> dict:
        if not shard:
            return self._failed(400, "missing required parameter: shardId")
        rows = feed_page(self.feeds[shard], after, limit).orderBy("sequence").collect() if shard in self.feeds else []
        messages = [{k: v for k, v in r.asDict().items() if k not in ("has_more", "last_sequence")} for r in rows]
        return self._done(shardId=shard, messages=messages, hasMore=bool(rows and rows[0]["has_more"]), lastSequence=rows[0]["last_sequence"] if rows else after)

    def checkpoint(self, shard: str = "", sequence: int = 0) -> dict:
        if not shard:
            return self._failed(400, "missing required field: shardId")
        if sequence <= 0:
            return self._failed(400, "appliedSequence must be greater than 0")
        state = self.states.get(shard, {"generated": 0, "applied": 0})
        if not state["generated"] and not state["applied"]:
            return self._failed(409, f"unknown shard: {shard}")
        if sequence <= state["applied"]:
            return self._failed(409, f"{sequence} is not ahead of current lastApplied {state['applied']}")
        if sequence > state["generated"]:
            return self._failed(409, f"{sequence} exceeds lastGenerated {state['generated']}")
        state["applied"] = sequence
        return self._done(acknowledged=True, shardId=shard, appliedSequence=sequence)
