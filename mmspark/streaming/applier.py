"""The idempotent out-of-order applier as a stateful stream, and a durable checkpoint."""

import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mmspark.sources.folders import read_text, write_text

OUTPUT = "shard string, sequence long, payload string, kind string"
STATE = "last long, waiting binary"


def _step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, waiting = (state.get[0], pickle.loads(state.get[1])) if state.exists else (0, {})
    rows = pd.concat([c for c in chunks]).sort_values("pos")
    out: list[tuple] = []
    for s, payload in zip(rows["sequence"], rows["payload"], strict=True):
        if s <= last:
            out.append((key[0], s, payload, "duplicate"))
            continue
        waiting[s] = payload
        while last + 1 in waiting:
            last += 1
            out.append((key[0], last, waiting.pop(last), "applied"))
    state.update((last, pickle.dumps(waiting)))
    yield pd.DataFrame(out, columns=["shard", "sequence", "payload", "kind"])


def apply_stream(messages: DataFrame, satellites: list[str] = ()) -> DataFrame:
    """Rows (shard, sequence, payload, kind) as messages (shard, pos, sequence, collection, payload) are applied or found to be duplicates."""
    if satellites:
        messages = messages.where(~messages["collection"].isin(*satellites))
    return messages.groupBy("shard").applyInPandasWithState(_step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def checkpoint_text(shards: dict[str, int]) -> str:
    return json.dumps({"version": 1, "shards": shards})


def checkpoint_read(text: str | None) -> dict[str, int]:
    """The sequences by shard; no text is a fresh start, a malformed one an error."""
    if text is None:
        return {}
    given = json.loads(text)
    if given.get("version") != 1 or not isinstance(given.get("shards"), dict):
        raise ValueError("malformed checkpoint")
    return {k: int(v) for k, v in given["shards"].items()}


def checkpoint_save(spark, path: str, shards: dict[str, int]) -> None:
    """Replace the durable checkpoint as a whole."""
    write_text(spark, path, checkpoint_text(shards))


def checkpoint_load(spark, path: str) -> dict[str, int]:
    return checkpoint_read(read_text(spark, path))
