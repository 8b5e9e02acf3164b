"""Index builds over key ranges with a changelog."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_bounds(low: str, high: str, parts: int) -> list[tuple[str, str]]:
    """[low, high) in `parts` ranges by the keys' first letters, read as digits; no high end is open.  None for no parts or an empty range."""
    if parts <= 0 or (high and low >= high):
        return []
    if not high:
        cuts = [low + chr(i * 255 // parts) for i in range(1, parts)]
    else:
        for width in range(1, 64):  # as few letters as tell the parts apart
            a, b = (int.from_bytes(x.encode("latin-1")[:width].ljust(width, b"\0"), "big") for x in (low, high))
            if b - a >= parts:
                break
        numbers = [a + i * (b - a) // parts for i in range(1, parts)]
        cuts = [n.to_bytes(width, "big").rstrip(b"\0").decode("latin-1") for n in numbers]
    return list(zip([low, *cuts], [*cuts, high], strict=True))


def split_points(keys: DataFrame, key: str, parts: int) -> DataFrame:
    """(part, key): the distinct keys at the places floor(i / parts * m); all of them if there are fewer than parts.

    Ranks come from counts of key ranges, so no task ranks all keys.
    """
    distinct = keys.select(F.col(key).alias("key")).where("key is not null").distinct()
    m = distinct.count()
    if parts <= 1 or not m:
        return distinct.limit(0).select(F.lit(0).alias("part"), "key")
    cells = min(64, m)
    if cells > 1 and dict(distinct.dtypes)["key"] == "string":  # strings have no percentiles: those of a bounded sample by hash will do as cells
        share = min(1.0, 4096 / m) * (1 << 30)
        drawn = sorted(r[0] for r in distinct.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share).collect())
        bounds = sorted({drawn[i * len(drawn) // cells] for i in range(1, cells)}) if drawn else []
    else:
        bounds = distinct.agg(F.percentile_approx("key", [i / cells for i in range(1, cells)]).alias("b")).first()["b"] if cells > 1 and dict(distinct.dtypes)["key"] in ("int", "bigint", "double") else []
    cell = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("key"))) if bounds else F.lit(0)
    placed = distinct.withColumn("cell", cell)
    before = F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))  # over 64 rows at most
    offsets = placed.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = placed.withColumn("rn", F.row_number().over(Window.partitionBy("cell").orderBy("key"))).join(F.broadcast(offsets), "cell")
    place = F.col("before") + F.col("rn") - 1
    if m < parts:
        return ranked.select((place + 1).cast("int").alias("part"), "key")
    wanted = {int(i / parts * m): i for i in range(parts - 1, 0, -1)}
    at = F.create_map(*(F.lit(x) for kv in sorted(wanted.items()) for x in kv))
    return ranked.where(place.isin(*wanted)).select(at[place.cast("int")].alias("part"), "key")


def build_sorted(df: DataFrame, key: str, parts: int) -> DataFrame:
    """The rows in `parts` key ranges, each sorted: what a parallel index build writes."""
    return df.repartitionByRange(parts, key).sortWithinPartitions(key)


def apply_changelog(index: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Rows (key, value) after a log (pos, op, key, value): the last entry of a key wins, REMOVE drops it."""
    last = log.groupBy(key).agg(F.max_by(F.struct("op", "value"), "pos").alias("w"))
    joined = index.join(last, key, "full_outer")
    return joined.where(F.coalesce(F.col("w.op") != "REMOVE", F.lit(True))).select(key, F.when(F.col("w").isNotNull(), F.col("w.value")).otherwise(F.col("value")).alias("value"))


@dataclass
class Changelog:
    """Writes during a build, in order, within a byte budget."""

    budget: int
    entries: list[tuple[str, str, str, bytes]] = field(default_factory=list)
    used: int = 0

    def append(self, op: str, key: str, rev: str, data: bytes) -> bool:
        cost = 105 + len(key.encode()) + len(rev.encode()) + len(data)
        if self.used + cost > self.budget:
            return False
        self.entries.append((op, key, rev, data))
        self.used += cost
        return True


@dataclass
class Build:
    """The states of a build; writes are buffered only while a background build runs."""

    background: bool = False
    state: str = "Idle"
    STATES = ("Idle", "Building", "ApplyingChangelog", "Swapping", "Complete")

    def advance(self) -> str:
        at = self.STATES.index(self.state)
        self.state = self.STATES[min(at + 1, len(self.STATES) - 1)]
        return self.state

    def fail(self) -> str:
        self.state = "Failed"
        return self.state

    @property
    def buffers_writes(self) -> bool:
        return self.background and self.state == "Building"
