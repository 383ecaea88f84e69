"""Streams of flows: tumbling host windows and idle sessions with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def host_windows(stream: DataFrame, seconds: int, lateness: str = "10 minutes", risk: float = 0.5) -> DataFrame:
    """Per source file, host and window: flows, attacks, high-risk flows, highest probability. stream: ts (timestamp), source_file, host, major_label, major_prob."""
    attack = F.col("major_label") != "benign"
    per = stream.withWatermark("ts", lateness).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "source_file", "host")
    return per.agg(F.count("*").alias("flow_count"), F.count_if(attack).alias("attack_count"), F.count_if(attack & (F.col("major_prob") >= risk)).alias("high_risk_count"), F.max("major_prob").alias("max_prob")).select(
        F.unix_seconds("w.start").alias("window_start"), "source_file", "host", "flow_count", "attack_count", "high_risk_count", "max_prob"
    )


def idle_sessions(stream: DataFrame, idle: float = 120.0, lateness: str = "10 minutes") -> DataFrame:
    """Finished sessions of keyed packets: key, start, end, packets. A session ends when the watermark passes its last packet by more than idle seconds.

    stream: ts (timestamp), key. Per key only the open session's start, end and count are state.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        open_ = list(state.get) if state.exists else None
        if state.hasTimedOut:
            done.append(open_)
            state.remove()
            open_ = None
        else:
            times = sorted(t for f in frames for t in f["ts"].astype("int64").floordiv(1000))
            for t in times:
                if open_ is not None and t - open_[1] > idle * 1e6:
                    done.append(open_)
                    open_ = None
                open_ = [t, t, 1] if open_ is None else [min(open_[0], t), max(open_[1], t), open_[2] + 1]
            if open_ is not None:
                state.update(tuple(open_))
                state.setTimeoutTimestamp(max(int(open_[1] / 1000 + idle * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame({"key": key[0], "start_us": [d[0] for d in done], "end_us": [d[1] for d in done], "packets": [d[2] for d in done]})

    marked = stream.select(F.col("ts"), F.col("key")).withWatermark("ts", lateness)
    return marked.groupBy("key").applyInPandasWithState(step, "key string, start_us long, end_us long, packets long", "start_us long, end_us long, packets long", "append", GroupStateTimeout.EventTimeTimeout)
