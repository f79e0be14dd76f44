"""Token buckets over a stream against a plain loop."""

import math
from datetime import datetime, timedelta, timezone

import pytest

from docbasin.streaming import limits

LIMITS = {"search": 6.0, "chat": 2.0}


def plain(rows):
    buckets, out = {}, {}
    for kind, who, ts, i in rows:
        rate = LIMITS.get(kind, 0)
        if not rate:
            out[i] = (True, None)
            continue
        tokens, at = buckets.get((kind, who), (rate, ts))
        tokens = min(rate, tokens + (ts - at).total_seconds() * rate / 60)
        ok = tokens >= 1
        out[i] = (ok, None if ok else max(1, math.ceil((1 - tokens) / (rate / 60))))
        buckets[kind, who] = (tokens - ok, ts)
    return out


def test_buckets_last_from_batch_to_batch(spark, tmp_path):
    before = spark.conf.get(limits.PROVIDER[0], None)
    spark.conf.set(*limits.PROVIDER)
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    rows = [(k, w, start + timedelta(seconds=7 * i + (k == "chat")), 10 * i + n) for i in range(24) for n, (k, w) in enumerate([("search", "ann"), ("search", "bob"), ("chat", "ann"), ("free", "ann")]) if (i + n) % 5]
    rows.sort(key=lambda r: r[2])
    schema = "kind string, identity string, ts timestamp, request_id long"
    try:
        for part in range(3):
            own = rows[part * len(rows) // 3 : (part + 1) * len(rows) // 3]
            spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = limits.limited(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), LIMITS)
            query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
            try:
                assert query.awaitTermination(100)
            finally:
                query.stop()
        got = {r.request_id: (r.allowed, r.retry_after) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    except Exception as e:
        if "rocksdb" in str(e).lower() and "UnsatisfiedLink" in str(e):
            pytest.skip("no RocksDB here")
        raise
    finally:
        spark.conf.set(limits.PROVIDER[0], before) if before else spark.conf.unset(limits.PROVIDER[0])
    assert got == plain(rows) and not all(ok for ok, _ in got.values())
