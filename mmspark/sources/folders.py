"""Folders that all executors share, for stored indexes, streams and copies."""

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def shared(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one spark.checkpoint.dir names (in local mode, where it names none, below one of our own); gone when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="mmspark-"))
        base = _own[0]
    _made.append((spark, f"{base.rstrip('/')}/{purpose}-{uuid4().hex}"))
    return _made[-1][1]


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return bool(fs.exists(p) and fs.delete(p, True))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a file as a whole: written beside it, then renamed."""
    fs, p = file_system(spark, path)
    _, beside = file_system(spark, path + ".tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"can't rename to {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A file's text; of one that a stop in write_text left beside it, that; None if there is neither."""
    for name in (path, path + ".tmp"):
        fs, p = file_system(spark, name)
        if fs.exists(p):
            stream = fs.open(p)
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            return text
    return None


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The table, written once to a shared folder and read from there."""
    path = shared(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended; a local folder goes below
            pass
    _made.clear()
    while _own:
        shutil.rmtree(_own.pop(), ignore_errors=True)


atexit.register(clear)
