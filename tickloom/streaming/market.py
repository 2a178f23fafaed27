"""Market state as one stateful operator per ticker, and as tables that others can read."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.validation import split, tick_reasons
from ..operators import market_state
from ..operators.market_state import BUCKET_S, RETAIN_S
from .session import STATEFUL
from .versions import Versions

#: `state` is set in a ticker's last row of a batch only: both states as they are then.
OUT = "ticker string, seq long, event_ms long, outcome string, windowApplied boolean, windowBuckets long, last double, state string"
STATE = "tick struct<event_ms:long,bid:double,ask:double,last:double,volume:long,offset:long,produced_ms:long,correlationId:string>, buckets array<struct<bucket:long,pv:double,v:double>>, lastOffset long"
TICK = ["event_ms", "bid", "ask", "last", "volume", "offset", "produced_ms", "correlationId"]
#: Both states of a ticker, published as one version.
TABLES = {"tick": ["ticker"], "window": ["ticker"]}
TICKS = "ticker string, bid double, ask double, last double, volume long, event_ms long, offset long, seq long, produced_ms long, correlationId string"
LEAST = np.iinfo(np.int64).min
BUCKET = np.dtype([("bucket", "<i8"), ("pv", "<f8"), ("v", "<f8")])


class MarketState(StatefulProcessor):
    """Latest tick without expiry; last offset and buckets that expire together after the window's TTL.

    As the offset guard expires with the window, a redelivery after that much silence is added again.
    """

    def __init__(self, bucket_s: int = BUCKET_S, retain_s: int = RETAIN_S, ttl_ms: int = 600_000):
        self.bucket_s, self.retain_s, self.ttl_ms = bucket_s, retain_s, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tick = handle.getValueState("tick", "event_ms long, bid double, ask double, last double, volume long, offset long, produced_ms long, correlationId string")
        # The offset guard and the buckets (bucket, pv, v, each as 8 bytes) are one value: read once, written once, gone together.
        self.window = handle.getValueState("window", "offset long, buckets binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        frame = frames[0] if len(frames) == 1 else pd.concat(frames)
        order = np.argsort(frame["seq"].to_numpy(np.int64), kind="stable")  # a batch's rows come in any order
        column = lambda c, kind: frame[c].to_numpy(kind)[order]
        ms, offsets, seq, last = column("event_ms", np.int64), column("offset", np.int64), column("seq", np.int64), column("last", np.float64)
        state, held = self.tick.get(), self.window.get()
        # Both guards are running maxima, so the rows are judged all at once.
        newest = np.maximum.accumulate(np.r_[state[0] if state else LEAST, ms])[:-1]
        top = np.maximum.accumulate(np.r_[held[0] if held else LEAST, offsets])
        outcome = np.where(ms > newest, "APPLIED", np.where(ms == newest, "DUPLICATE", "OLDER"))
        added = offsets > top[:-1]
        buckets = {b: [x, y] for b, x, y in np.frombuffer(held[1], BUCKET).tolist()} if held else {}
        at = np.flatnonzero(added)
        counts = np.full(len(at) + 1, len(buckets))
        if len(at):
            bucket = ms[at] // (self.bucket_s * 1000) * self.bucket_s
            v = column("volume", np.float64)[at]
            pv = last[at] * v
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # ticks in a row of one bucket count at once
            for a, z, b, x, y in zip(first.tolist(), [*first[1:].tolist(), len(at)], bucket[first].tolist(), np.add.reduceat(pv, first).tolist(), np.add.reduceat(v, first).tolist(), strict=True):
                had = buckets.get(b, (0.0, 0.0))
                buckets[b] = [had[0] + x, had[1] + y]
                for old in [o for o in buckets if o < b - self.retain_s]:
                    del buckets[old]
                counts[a + 1 : z + 1] = len(buckets)
            self.window.update((int(top[-1]), np.array([(b, *x) for b, x in buckets.items()], BUCKET).tobytes()))
        if (outcome == "APPLIED").any():
            t = frame.iloc[order[np.flatnonzero(outcome == "APPLIED")[-1]]]
            state = (int(t["event_ms"]), float(t["bid"]), float(t["ask"]), float(t["last"]), int(t["volume"]), int(t["offset"]), None if pd.isna(t["produced_ms"]) else int(t["produced_ms"]), None if pd.isna(t["correlationId"]) else t["correlationId"])
            self.tick.update(state)
        now = {"tick": dict(zip(TICK, state, strict=True)), "buckets": [{"bucket": int(b), "pv": float(x), "v": float(y)} for b, (x, y) in sorted(buckets.items())], "lastOffset": int(top[-1])}
        yield pd.DataFrame({"state": [None] * (len(frame) - 1) + [json.dumps(now)], "ticker": key[0], "seq": seq, "event_ms": ms, "outcome": outcome, "windowApplied": added, "windowBuckets": counts[np.cumsum(added)], "last": last})

    def close(self) -> None:
        pass


def market_updates(ticks: DataFrame, bucket_s: int = BUCKET_S, retain_s: int = RETAIN_S, ttl_ms: int = 600_000) -> DataFrame:
    """A row for each tick: its outcome, whether its volume counted, and the buckets held then. Needs the RocksDB state store."""
    for name, kind in (("produced_ms", "long"), ("correlationId", "string")):  # a feed may lack them
        ticks = ticks if name in ticks.columns else ticks.withColumn(name, F.lit(None).cast(kind))
    return ticks.groupBy("ticker").transformWithStateInPandas(MarketState(bucket_s, retain_s, ttl_ms), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")


def valid(ticks: DataFrame, now_ms: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(ticks that may be projected, the others with `reasons`), of a stream too: a bad tick must not reach the state."""
    return split(ticks, tick_reasons(now_ms))


def quarantine_stream(bad: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write rejected ticks, each once, from the same log as the projection and with a checkpoint of its own, so neither waits for the other."""
    rows = bad.withColumn("rejectedAtMs", F.unix_millis(F.current_timestamp()))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def market_tables(spark, path: str) -> Versions:
    return Versions(spark, path, TABLES)


def publish_state(tables: Versions, out: str | None = None, ttl_ms: int = 600_000) -> Callable[[DataFrame, int], None]:
    """foreachBatch function over `market_updates`: both states of the tickers that have changed appear as one version.

    out: also write each tick's outcome there; a batch that is run again overwrites its own folder.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # the stateful operator runs once for all that is written
        try:
            if out:
                batch.drop("state").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            s = batch.filter("state is not null").select("ticker", F.from_json("state", STATE).alias("s"))
            expires = F.unix_millis(F.current_timestamp()) + ttl_ms
            tables.publish(batch_id, {"tick": s.select("ticker", "s.tick.*"), "window": s.select("ticker", "s.buckets", "s.lastOffset", expires.alias("expires_ms"))})
        finally:
            batch.unpersist()

    return run


def market_stream(ticks: DataFrame, tables: Versions, checkpoint: str, out: str | None = None, bucket_s: int = BUCKET_S, retain_s: int = RETAIN_S, ttl_ms: int = 600_000, trigger: dict | None = None) -> StreamingQuery:
    """Keep the tables up to date with the ticks. The stream's session must be one that `session.stateful` gave."""
    updates = market_updates(ticks, bucket_s, retain_s, ttl_ms)
    return updates.writeStream.foreachBatch(publish_state(tables, out, ttl_ms)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def market_now(tables: Versions, horizon_s: int = RETAIN_S, now_ms: int | None = None) -> DataFrame | None:
    """Each ticker's latest tick, with vwap over the reader's horizon, both of one version; null before the first.

    A window that has expired by now_ms (or the current time) is left out, as its keys would be.
    """
    version = tables.current()
    tick, window = tables.read("tick", version), tables.read("window", version)
    if tick is None:
        return None
    now = F.lit(now_ms) if now_ms is not None else F.unix_millis(F.current_timestamp())
    buckets = window.filter(F.col("expires_ms") > now).select("ticker", F.explode("buckets").alias("b")).select("ticker", "b.*")
    return tick.join(market_state.vwap(buckets, horizon_s), "ticker", "left")


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": STATEFUL["spark.sql.streaming.stateStore.providerClass"]}
