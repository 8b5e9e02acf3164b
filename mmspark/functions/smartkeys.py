"""Prefix-sharded graph keys: building, cutting, sharding, validation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mmspark.functions.hashing import fnv1a32

STRATEGIES = ("enterprise-hash-smart-edge", "enterprise-hex-smart-vertex", "enterprise-smart-edge-compat")


def shard_prefix(key: Column) -> Column:
    """What stands before the first colon; the whole key without one."""
    return F.substring_index(key, ":", 1)


def smart_value(key: Column) -> Column:
    """What stands before the first colon; empty without one."""
    return F.when(F.instr(key, ":") > 0, shard_prefix(key)).otherwise(F.lit(""))


def strip_collection(handle: Column) -> Column:
    """The key of `collection/key`."""
    slash = F.instr(handle, "/")
    return F.when(slash > 0, F.substr(handle, slash + 1)).otherwise(handle)


def collection_of(handle: Column, whole_without_slash: bool) -> Column:
    """The collection of `collection/key`; without a slash the whole handle, or nothing."""
    return F.when(F.instr(handle, "/") > 0, F.substring_index(handle, "/", 1)).otherwise(handle if whole_without_slash else F.lit(""))


def step_prefix(handle: Column) -> Column:
    return shard_prefix(strip_collection(handle))


def shard_index(value: Column, shards: int) -> Column:
    return F.pmod(fnv1a32(value), F.lit(shards)).cast("int")


def responsible_shard(key: Column, shards: int, strategy: str = STRATEGIES[1]) -> Column:
    """The shard of a key; the strategies differ in name only."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown sharding strategy: {strategy}")
    return shard_index(shard_prefix(key), shards)


def shard_name(collection: Column, index: Column) -> Column:
    return F.concat(collection, F.lit("_s"), index.cast("string"))


def is_responsible(collection: Column, shard: Column, mapping: dict[str, str]) -> Column:
    """Whether the mapped shard of the collection is this one; an unknown collection is on none."""
    if not mapping:
        return F.lit(False)
    known = F.create_map(*(F.lit(x) for kv in sorted(mapping.items()) for x in kv))
    return F.coalesce(known[collection] == shard, F.lit(False))


def smart_key(value: Column, local: Column) -> Column:
    return F.concat(value, F.lit(":"), local)


def smart_edge_key(from_value: Column, to_value: Column, local: Column) -> Column:
    return F.concat(from_value, F.lit(":"), to_value, F.lit(":"), local)


def validate_vertex(key: Column, attribute: Column, name: str) -> Column:
    """struct(ok, error) of a vertex: it needs the attribute, a colon in the key, and that the two agree."""
    missing = attribute.isNull() | (attribute == "")
    error = F.when(missing, F.lit(f"smart graph attribute '{name}' is missing")).when(F.instr(key, ":") == 0, F.lit("key has no smart prefix"))
    error = error.when(smart_value(key) != attribute, F.lit(f"key prefix differs from attribute '{name}'"))
    return F.struct(error.isNull().alias("ok"), error.alias("error"))


def validate_edge(source: Column, target: Column, disjoint: bool, satellites: list[str] = ()) -> Column:
    """struct(ok, error) of an edge: in a disjoint graph both ends share the prefix, unless one is a satellite."""
    if not disjoint:
        return F.struct(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    satellite = F.lit(False)
    if satellites:
        satellite = collection_of(source, False).isin(*satellites) | collection_of(target, False).isin(*satellites)
    ok = satellite | (smart_value(strip_collection(source)) == smart_value(strip_collection(target)))
    return F.struct(ok.alias("ok"), F.when(~ok, F.lit("edge crosses prefixes of a disjoint graph")).alias("error"))


def valid_disjoint_path(start: Column, current: Column) -> Column:
    return shard_prefix(start) == shard_prefix(current)


def is_smart_to_satellite(source: Column, target: Column, satellites: list[str]) -> Column:
    """Exactly one end is a satellite."""
    inside = lambda h: collection_of(h, True).isin(*satellites) if satellites else F.lit(False)
    return inside(source) != inside(target)


def edge_part(source_shard: Column, target_shard: Column, shard: Column) -> Column:
    """The physical part an edge has on a shard: local, from or to; null elsewhere."""
    return F.when((source_shard == shard) & (target_shard == shard), "local").when(source_shard == shard, "from").when(target_shard == shard, "to")
