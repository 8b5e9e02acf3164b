"""Audit lines: eight fields between pipes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("timestamp", "server", "topic", "username", "database", "client_ip", "auth_method", "text")
TOPICS = ("authentication", "authorization", "collection", "database", "document", "hotbackup", "service", "view")


def format_line(*fields: Column) -> Column:
    """One line; a null is an empty field."""
    return F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields))


def parse_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """The fields of each line; the text keeps its own pipes."""
    parts = F.split(F.col(line), "\\|", len(FIELDS))
    return df.select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(FIELDS)))


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    """Lines to a text sink; only file:// and other Hadoop paths, no other scheme of a logger."""
    if path.startswith("syslog://"):
        raise ValueError("syslog is not a Spark sink")
    df.select("value").write.mode(mode).text(path)
