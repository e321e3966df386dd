"""Traces while they are recorded: traffic over time, and blocks as they close."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import is_comm


def live_traffic(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Bytes and messages of tumbling windows; a window is final once `late` has passed beyond it."""
    e = events.where(is_comm(F.col("record"))).withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000")))
    return e.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.sum("msg_length").alias("bytes"), F.count("*").alias("messages")).select(
        F.col("window.start").alias("start"), "bytes", "messages"
    )


CLOSED = "thread_id long, depth int, name string, start_ns long, finish_ns long"


def live_blocks(enter_leave: DataFrame) -> DataFrame:
    """Blocks in the order in which they close; a thread's state is its stack of open blocks."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, starts = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values("seq_no")
        out = []
        for phase, name, ts in zip(rows["phase"], rows["name"], rows["ts_ns"], strict=True):
            if phase == "E":
                names.append(name)
                starts.append(int(ts))
            elif names:
                out.append((key[0], len(names) - 1, names.pop(), starts.pop(), int(ts)))
        state.update((names, starts))
        yield pd.DataFrame(out, columns=["thread_id", "depth", "name", "start_ns", "finish_ns"])

    return enter_leave.groupBy("thread_id").applyInPandasWithState(step, CLOSED, "names array<string>, starts array<long>", "append", GroupStateTimeout.NoTimeout)
