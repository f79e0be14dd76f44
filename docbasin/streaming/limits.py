"""Rate limits over a stream of requests: a token bucket for each class and identity, as keyed state that expires."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State stores that keyed state with timers needs; set it before the stream starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SCHEMA = "kind string, identity string, ts timestamp, request_id long, allowed boolean, retry_after int"


def refilled(tokens: float, seconds: float, per_minute: float) -> float:
    """Tokens after some time: a bucket holds a minute's worth at most."""
    return min(per_minute, tokens + max(seconds, 0.0) * per_minute / 60.0)


class TokenBucket(StatefulProcessor):
    """Requests of one (class, identity) in the order of their time: each takes a token or says how long to wait for one.

    The state is a number and a time. When a bucket is full again a timer drops it: a new one is full as well.
    """

    def __init__(self, limits: dict[str, float]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind, identity = key
        per_minute = self.limits.get(kind, 0.0)
        batch = pd.concat(list(rows)).sort_values(["ts", "request_id"], kind="stable")  # one key's requests of a micro-batch
        if per_minute <= 0:  # a class without a limit
            yield pd.DataFrame({"kind": kind, "identity": identity, "ts": batch.ts, "request_id": batch.request_id, "allowed": True, "retry_after": None})
            return
        tokens, at = self.bucket.get() if self.bucket.exists() else (per_minute, None)
        allowed, wait = [], []
        for ts in batch.ts.map(lambda t: t.timestamp()):
            tokens = tokens if at is None else refilled(tokens, ts - at, per_minute)
            at = ts if at is None else max(at, ts)
            allowed.append(tokens >= 1.0)
            wait.append(None if tokens >= 1.0 else max(1, math.ceil((1.0 - tokens) / (per_minute / 60.0))))
            tokens -= tokens >= 1.0
        self.bucket.update((tokens, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        full = (per_minute - tokens) / (per_minute / 60.0)
        self.handle.registerTimer(max(int((at + full) * 1000), timerValues.getCurrentWatermarkInMs()) + 1)
        yield pd.DataFrame({"kind": kind, "identity": identity, "ts": batch.ts, "request_id": batch.request_id, "allowed": allowed, "retry_after": pd.array(wait, "Int32")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited(requests: DataFrame, limits: dict[str, float], late: str = "10 minutes") -> DataFrame:
    """A stream of requests (kind, identity, ts, request_id) -> with allowed and retry_after (seconds).

    `limits` has tokens a minute by class; a class without one isn't limited. Requests of a key are taken in the order of
    their time within a micro-batch; one that comes late finds the bucket as later ones have left it, and one later than the
    watermark (`late`) is dropped.
    """
    keyed = requests.select("kind", "identity", "ts", "request_id").withWatermark("ts", late).groupBy("kind", "identity")
    return keyed.transformWithStateInPandas(TokenBucket(limits), SCHEMA, "Append", "EventTime")
