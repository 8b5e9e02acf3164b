"""Plan data: graphs, satellites, traversal nodes, the top-k pattern rule, follower reads, options."""

from dataclasses import asdict, dataclass, field, replace
from sys import getsizeof

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SmartGraph:
    name: str
    smart_attribute: str
    shards: int = 1
    disjoint: bool = False


class Satellites:
    """Collections that every server holds whole; joins may broadcast them below a size."""

    REPLICATION_FACTOR, SHARDS = 0, 1

    def __init__(self, limit_bytes: int = 64 << 20):
        self._names: set[str] = set()
        self.limit_bytes = limit_bytes

    def register(self, name: str) -> None:
        self._names.add(name)

    def unregister(self, name: str) -> None:
        self._names.discard(name)

    def is_registered(self, name: str) -> bool:
        return name in self._names

    def all(self) -> list[str]:
        return sorted(self._names)

    def clear(self) -> None:
        self._names.clear()

    @staticmethod
    def is_satellite(replication_factor: int) -> bool:
        return replication_factor == Satellites.REPLICATION_FACTOR

    @staticmethod
    def write_concern(servers: list[str]) -> int:
        return len(servers)

    @staticmethod
    def assign(servers: list[str], prefix: str, number: int) -> dict:
        """One shard: the first server leads, the others follow."""
        return {"shard": f"{prefix}{number}", "leader": servers[0] if servers else "", "followers": list(servers[1:])}

    def join(self, df: DataFrame, name: str, satellite: DataFrame, on, how: str = "inner") -> DataFrame:
        """A join with a satellite, broadcast if its size, as the optimizer knows it, is below the limit."""
        size = int(str(satellite._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return df.join(F.broadcast(satellite) if self.is_registered(name) and size <= self.limit_bytes else satellite, on, how)


NODE_TYPES = {22: "traversal", 24: "shortest_path", 25: "enumerate_paths"}


@dataclass(frozen=True)
class TraversalSpec:
    node_type: int = 22
    graph: str = ""
    smart: bool = False
    disjoint: bool = False
    min_depth: int = 1
    max_depth: int = 1
    shards: dict[str, str] = field(default_factory=dict)
    satellite: bool = False
    one_shard: bool = False
    local: bool = True

    def to_data(self) -> dict:
        return asdict(self)

    @classmethod
    def from_data(cls, data: dict) -> "TraversalSpec":
        """The node of a data bag; an unknown type is an error."""
        if data.get("node_type") not in NODE_TYPES:
            raise ValueError(f"unknown graph node type: {data.get('node_type')}")
        return cls(**data)

    def clone(self, **changes) -> "TraversalSpec":
        return replace(self, **changes)

    @property
    def kind(self) -> str:
        return NODE_TYPES[self.node_type]

    def memory_bytes(self) -> int:
        """An estimate: the node, its graph's name and its shard names."""
        return getsizeof(self) + sum(len(x.encode()) for kv in self.shards.items() for x in kv) + len(self.graph.encode())

    def runs_on_one_shard(self, fixed_start: bool) -> bool:
        """A smart graph and a known start: the work stays on the start's shard."""
        return self.smart and fixed_start


@dataclass
class PlanNode:
    """One node of a linear plan; `below` is what it reads."""

    kind: str
    below: "PlanNode | None" = None
    limit: int = 0
    offset: int = 0
    path: str = ""
    ascending: bool = True
    wand: bool = False
    heap: int = 0


def annotate_top_k(nodes: list[PlanNode]) -> int:
    """Mark every view read by sort-by-bm25-descending and a limit without offset, each right above the next; returns how many."""
    found = 0
    for top in nodes:
        sort = top.below
        view = sort.below if sort else None
        if top.kind != "limit" or top.limit <= 0 or top.offset or not view or sort.kind != "sort" or view.kind != "view":
            continue
        if not sort.ascending and "bm25" in sort.path.lower():
            view.wand, view.heap, found = True, top.limit, found + 1
    return found


@dataclass(frozen=True)
class CdcOptions:
    enabled: bool = False
    target: str = ""
    max_lag_seconds: float = 30.0
    batch_size: int = 1000
    threads: int = 4
    max_retries: int = 5
    checkpoint_seconds: int = 60

    def __post_init__(self):
        if self.enabled and not self.target:
            raise ValueError("an enabled replication needs a target")
        if self.enabled and min(self.batch_size, self.threads, self.checkpoint_seconds) <= 0:
            raise ValueError("batch size, threads and checkpoint interval must be positive")


def allows_dirty_read(headers: dict[str, str], name: str) -> bool:
    """The header's exact lower-case name with the value true, in any case."""
    return headers.get(name, "").lower() == "true"


def dirty_read_headers(follower_used: bool, name: str) -> dict[str, str]:
    """What an answer says of itself: the header, if a follower may have served it."""
    return {name: "true"} if follower_used else {}


def fresh_enough(lag_ms: Column, max_lag_ms: int, eventual: bool = False) -> Column:
    """Whether a follower may serve: always if reads need only be consistent in the end, else within the bound, of which 0 never lets it."""
    if eventual:
        return F.lit(True)
    return (lag_ms <= max_lag_ms) if max_lag_ms > 0 else F.lit(False)


class FollowerRouter:
    """Round robin over leader and followers of each shard; unknown shards are skipped."""

    def __init__(self, servers: dict[str, list[str]]):
        self.servers, self._next = servers, 0

    def route(self, shards: list[str]) -> dict[str, str]:
        out = {}
        for s in shards:
            if own := self.servers.get(s):
                out[s] = own[self._next % len(own)]
                self._next += 1
        return out
