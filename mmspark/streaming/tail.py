"""The tail loop as a stream: entries to numbered messages, batches, lag and a durable checkpoint."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mmspark.operators import cdc
from mmspark.plans.specs import CdcOptions
from mmspark.sources.folders import read_text, write_text


class TailLoop:
    """Reads entries (seq, micros, collection, shard, ...) and writes messages with `sequence` and `batch` by shard.

    A micro-batch is one poll: its entries are numbered on from the shard's last
    sequence and cut into batches, the last of which is flushed short.  What each
    micro-batch starts from is kept under its number, so one that is run again writes
    the same rows over the first ones.  Positions: the highest seq taken of each shard;
    entries at or below it are not taken again.  Satellites never enter.
    """

    def __init__(self, spark: SparkSession, folder: str, options: CdcOptions = CdcOptions(), satellites: list[str] = ()):
        self.spark, self.folder, self.options, self.satellites = spark, folder, options, list(satellites)
        self.query = None

    def _state(self, epoch: int) -> dict:
        """What micro-batch `epoch` starts from: {shard: [position, sequence, batch, last micros]}."""
        text = read_text(self.spark, f"{self.folder}/state/{epoch}.json") if epoch else None
        return json.loads(text) if text else {}

    def _poll(self, entries: DataFrame, epoch: int) -> None:
        before = self._state(epoch)
        known = self.spark.createDataFrame([(k, *v[:3]) for k, v in before.items()], "shard string, position long, base long, batches long")
        live = entries.where(~F.col("collection").isin(*self.satellites)) if self.satellites else entries
        fresh = live.join(F.broadcast(known), "shard", "left").where(F.col("seq") > F.coalesce("position", F.lit(-1)))
        rows = cdc.sequenced(fresh, "shard", "seq")
        batch = F.floor((F.col("sequence") - 1) / self.options.batch_size).cast("long") + 1 + F.coalesce("batches", F.lit(0))
        rows = rows.withColumn("batch", batch).withColumn("sequence", F.col("sequence") + F.coalesce("base", F.lit(0))).drop("position", "base", "batches")
        rows.write.mode("overwrite").parquet(f"{self.folder}/messages/epoch={epoch}")
        done = self.spark.read.parquet(f"{self.folder}/messages/epoch={epoch}")
        after = dict(before)
        for r in done.groupBy("shard").agg(F.max("seq").alias("p"), F.max("sequence").alias("s"), F.max("batch").alias("b"), F.max("micros").alias("m")).collect():
            after[r["shard"]] = [r["p"], r["s"], r["b"], r["m"]]
        write_text(self.spark, f"{self.folder}/state/{epoch + 1}.json", json.dumps(after))
        write_text(self.spark, f"{self.folder}/checkpoint.json", json.dumps({"version": 1, "shards": {k: v[1] for k, v in after.items()}}))

    def start(self, entries: DataFrame, available_now: bool = False):
        """Poll until stopped, or (available_now) until everything there is has been taken."""
        if self.query is not None and self.query.isActive:
            raise RuntimeError("replication is already running")
        writer = entries.writeStream.foreachBatch(self._poll).option("checkpointLocation", f"{self.folder}/stream")
        self.query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 milliseconds")).start()
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    def messages(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/messages")

    def lag(self, now_micros: int) -> DataFrame:
        return cdc.lag(self.messages(), now_micros, self.options.max_lag_seconds)
