"""Consecutive pairs of a stream of visits: an extension that goes beyond batch work.

A visit that arrives is paired with the user's last one, as a stream can't look ahead. State is one visit per user and is dropped when
the watermark has passed it by the pairs' horizon.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "user_id long, src_ts timestamp, dst_ts timestamp, src_item string, dst_item string, delta_hours double"
STATE = "ts timestamp, item string"


def streaming_pairs(visits: DataFrame, horizon_hours: float = 168.0, late: str = "1 hour") -> DataFrame:
    """Pairs of visits (user_id long, ts timestamp, item string) with 0 < delta_hours <= horizon, as they complete."""
    horizon = pd.Timedelta(hours=horizon_hours)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "item"])
        last = state.get if state.exists else None
        out = []
        for ts, item in zip(rows["ts"], rows["item"], strict=True):
            if last is not None and pd.Timedelta(0) < ts - last[0] <= horizon:
                out.append((key[0], last[0], ts, last[1], item, (ts - last[0]) // pd.Timedelta(seconds=1) / 3600.0))
            if last is None or ts >= last[0]:
                last = (ts, item)
        state.update(last)
        state.setTimeoutTimestamp(int((last[0] + horizon).timestamp() * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    marked = visits.withWatermark("ts", late).groupBy("user_id")
    return marked.applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
