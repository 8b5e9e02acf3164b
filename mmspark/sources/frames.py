"""Length-prefixed frames: four bytes of big-endian length, then the payload (C17)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PAYLOAD = 64 << 20


def frame(payload: Column) -> Column:
    """The frame of a payload; null if it is too long."""
    size = F.octet_length(payload)
    head = F.to_binary(F.lpad(F.hex(size.cast("long")), 8, "0"), F.lit("hex"))
    return F.when(size <= MAX_PAYLOAD, F.concat(head, payload))


def parse(data: Column) -> Column:
    """struct(complete, payload, consumed) of the first frame of a buffer."""
    size = F.when(F.octet_length(data) >= 4, F.conv(F.hex(F.substring(data, 1, 4)), 16, 10).cast("long"))
    complete = F.coalesce((size <= MAX_PAYLOAD) & (F.octet_length(data) >= size + 4), F.lit(False))
    payload = F.when(complete, F.substr(data, F.lit(5), size.cast("int")))
    return F.struct(complete.alias("complete"), payload.alias("payload"), F.when(complete, size + 4).otherwise(0).alias("consumed"))


def ack(status: Column) -> Column:
    """Eight bytes: the length 4 and the status."""
    return F.to_binary(F.concat(F.lit("00000004"), F.lpad(F.hex(status.cast("long")), 8, "0")), F.lit("hex"))
