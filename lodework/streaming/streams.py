"""Streams: rate limits with state, windowed latency, and ingestion that upserts batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latency_windows(events: DataFrame, ts: str = "ts", step: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls and mean latency per tumbling window and step; rows later than `late` are dropped once a window is closed.

    The same expression runs on a batch and on a stream (append mode).
    """
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, width), F.col(step).alias("step")).agg(F.count(F.lit(1)).alias("calls"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "step", "calls", F.round(F.col("total") / F.col("calls"), 6).alias("mean_value"))


class Limiter:
    """Exact sliding-window limiter: a refused request isn't counted against its key."""

    def __init__(self, seconds: float, limit: int) -> None:
        self.seconds, self.limit = seconds, limit

    def decide(self, kept: list[float], times: list[float]) -> tuple[list[float], list[bool]]:
        out = []
        for t in times:
            while kept and kept[0] <= t - self.seconds:
                kept.pop(0)
            ok = len(kept) < self.limit
            if ok:
                kept.append(t)
            out.append(ok)
        return kept, out

    def batch(self, events: DataFrame, key: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
        """(event, key, ts, allowed): keys are sorted streams within partitions; a key of any number of events needs only its window in memory."""
        rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").cast("double").alias("t"), F.col(event).alias("event_id")).where("t is not null")
        rows = rows.repartition("key").sortWithinPartitions("key", "t", "event_id")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, kept = None, []
            for f in frames:
                ok = []
                for k, t in zip(f["key"], f["t"], strict=True):
                    if k != last:
                        last, kept = k, []
                    kept, allowed = self.decide(kept, [t])
                    ok += allowed
                yield pd.DataFrame({"event_id": f["event_id"], "key": f["key"], "t": f["t"], "allowed": ok})

        return rows.mapInPandas(run, "event_id long, key string, t double, allowed boolean")

    def stream(self, events: DataFrame, key: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
        """The same decisions on a stream, with the accepted times of each key as state."""
        rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").cast("double").alias("t"), F.col(event).alias("event_id"))
        me = self

        def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            kept = list(state.get[0]) if state.exists else []
            f = pd.concat(list(frames)).sort_values(["t", "event_id"])
            kept, ok = me.decide(kept, f["t"].tolist())
            state.update((kept,))
            yield pd.DataFrame({"event_id": f["event_id"], "key": k[0], "t": f["t"], "allowed": ok})

        return rows.groupBy("key").applyInPandasWithState(run, "event_id long, key string, t double, allowed boolean", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def ingest_stream(source: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs `write` once per micro-batch of what has arrived, then stops; a repeated batch is an idempotent upsert."""
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
