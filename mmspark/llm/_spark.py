"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Most bytes of files that a side of a join may have and still be sent to every task.
SMALL_BYTES = 8 << 20
_left: dict[str, SparkSession] = {}
_local: list[str] = []


#: Bytes of an Arrow batch between the JVM and Python; Spark's own bound lets each side hold 64 MB a task.
ARROW_BYTES, _ARROW = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and bound the bytes of Arrow batches unless the session has its own bound."""
    if spark.conf.get(_ARROW) == "67108864b":
        spark.conf.set(_ARROW, ARROW_BYTES)
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "")
    if ROOT not in have.split(":"):
        environment["PYTHONPATH"] = f"{ROOT}:{have}".rstrip(":")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in local mode only, one of our own where it names none."""
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not (set_already := sc._jsc.sc().getCheckpointDir()).isEmpty():
        return set_already.get()
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="mmspark-"))
    return _local[0]


def delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def file_bytes(spark: SparkSession, path: str) -> int:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


class Steps:
    """Written tables of one run of an operator, in a folder of its own that all executors share.

    A step is dropped as soon as every later step that reads it is written.  What
    a returned DataFrame still reads stays until ``clear`` or the end of the process.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = ready(spark), {}
        self.folder = f"{shared_folder(spark)}/mmspark-{uuid4().hex}"
        _left[self.folder] = spark

    def keep(self, df: DataFrame) -> DataFrame:
        """Write the table and read it again, without its lineage."""
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        done = self.spark.read.schema(df.schema).parquet(path)
        self.paths[done] = path
        return done

    def drop(self, *steps: DataFrame | None) -> None:
        for df in steps:
            if df is not None and (path := self.paths.get(df)):
                delete(self.spark, path)

    def small(self, df: DataFrame) -> bool:
        """Whether a step's files are small enough to send the table to every task."""
        return file_bytes(self.spark, self.paths[df]) <= SMALL_BYTES

    def close(self) -> None:
        delete(self.spark, self.folder)
        _left.pop(self.folder, None)


def clear() -> None:
    """Delete what the results of earlier runs read; those DataFrames can't be read again."""
    for folder, spark in list(_left.items()):
        try:
            delete(spark, folder)
        except Exception:  # noqa: BLE001 - the session has ended; a local folder goes below
            pass
        _left.pop(folder, None)
    while _local:
        shutil.rmtree(_local.pop(), ignore_errors=True)


atexit.register(clear)


def often(df: DataFrame, key: str, rows: int, keys: int = 1024) -> list[tuple[int, int]]:
    """(key, count) of the keys that more than `rows` rows hold: the `keys` most frequent at most, from sketches of fixed size, one a task.

    Keys that one row in about 2000 or more holds are surely found.
    """
    found = df.agg(F.expr(f"approx_top_k({key}, {keys}, {8 * keys})").alias("top")).first()["top"] or []
    return [(x["item"], x["count"]) for x in found if x["item"] is not None and x["count"] > rows]


def join_spread(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", on: Sequence[str] = (), counted: DataFrame | None = None, rows: int = 512) -> DataFrame:
    """left join right on `key` (and `on`), where many rows of left may share a key and few of right do.

    The rows of a key that left holds often are dealt to salts by a hash of
    `spread`, and the rows of right go to all of its salts.  The list of such keys
    has 1024 entries at most.  `counted`: a written table with left's keys.  It is a
    merge join at every size.
    """
    hot = often(left if counted is None else counted, key, rows)
    if not hot:
        return left.join(right.hint("merge"), [key, *on], how)
    kind = left.schema[key].dataType.simpleString()
    salts = F.broadcast(left.sparkSession.createDataFrame([(k, -(-n // rows)) for k, n in hot], f"{key} {kind}, __salts int"))
    dealt = left.join(salts, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__salts")), F.lit(0)).cast("int")).drop("__salts")
    copied = right.join(salts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return dealt.join(copied.hint("merge"), [key, "__salt", *on], how).drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")
