"""The change log as a stream: per-key state, compacted as events come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "file_id long, change_type string, old_code string, new_code string, n long"
STATE = "first_op string, last_op string, old_code string, new_code string, n long, last_at long"


def change_type(first: str, last: str, n: int) -> str:
    return "deleted" if last == "deleted" else first if n == 1 else "modified"


def compact_stream(changes: DataFrame) -> DataFrame:
    """A stream of (file_id, op, code, ts, event_id) as updates of each key's compacted entry.

    The state of a key is a few fields, whatever its history. Events of a batch are folded in order
    of time; one that is older than the state's last only counts.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, old, new, n, at = state.get if state.exists else (None, None, None, None, 0, -(2**62))
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for op, code, ts in zip(rows["op"], rows["code"], rows["ts"].astype("int64"), strict=True):
            first, old = (op, code) if n == 0 else (first, old)
            last, new, at = (op, code, int(ts)) if ts >= at else (last, new, at)
            n += 1
        state.update((first, last, old, new, n, at))
        yield pd.DataFrame({"file_id": [key[0]], "change_type": [change_type(first, last, n)], "old_code": [old], "new_code": [new], "n": [n]})

    return changes.groupBy("file_id").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(changes: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Changes by window and kind; events later than ``late`` are dropped."""
    return changes.withWatermark("ts", late).groupBy(F.window("ts", width), "op").agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Take what is there, as one triggered run with a checkpoint, into a table in memory."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
