"""Streams with the semantics of the batch operators: superseding rows and as-of closes."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.asof import choose
from ..operators.latest import last_per_key
from ..session import ship
from ..sources.commits import Table, Version


#: Parts of a superseding table; a batch rewrites those that its keys fall into.
BUCKETS = 64
#: Versions that stay for readers that began with them.
KEPT = 3


def superseding(stream: DataFrame, keys: Sequence[str], order: str, table: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the last row of each key in a table of parts by key hash; see sources.commits.

    A micro-batch writes the parts that it touches anew and commits them with the others of the
    version before it, under its own number: one that is run again after a failure finds
    itself committed and does nothing. Readers see a batch whole or not at all; other writers'
    commits are kept.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = Table(spark, table)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = last_per_key(batch, list(keys), [F.col(order)]).withColumn("bucket", bucket).persist()

        def change(base: Version) -> tuple[dict, dict] | None:
            if base.notes.get(checkpoint, -1) >= number:
                return None
            touched = [f"bucket={r[0]}" for r in new.select("bucket").distinct().collect()]  # at most as many as there are parts
            before = own.read(base, batch.schema, touched)
            merged = last_per_key(before.unionByName(new.drop("bucket")), list(keys), [F.col(order)]).withColumn("bucket", bucket)
            folder = own.stage(merged.repartition("bucket"), "bucket") if touched else ""
            return {**base.parts, **{b: f"{folder}/{b}" for b in touched}}, {**base.notes, checkpoint: number}

        try:
            own.update(change)
            own.clean(KEPT)
        finally:
            new.unpersist()

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, table: str, schema) -> DataFrame:
    """The newest version of the table that superseding() keeps."""
    own = Table(spark, table)
    return own.read(own.head(), schema)


def closes(matches: DataFrame, prices: DataFrame, late: str = "1 hour", before: str = "30 days", after: str = "1 day") -> DataFrame:
    """Joined pairs of a match stream (match_key, pair, start) and a price stream (pair, ts, price).

    A stream-stream join with time bounds, so state is dropped once no price can be in reach;
    what arrives later than the watermark has no say. fold() of its output is the close.
    """
    m = matches.withWatermark("start", late)
    p = prices.withColumnRenamed("pair", "p_pair").withWatermark("ts", late)
    near = F.expr(f"pair = p_pair AND ts >= start - INTERVAL {before} AND ts <= start + INTERVAL {after}")
    return m.join(p, near).select("match_key", "start", "ts", "price")


CLOSED = "match_key long, start timestamp, close double, flagged boolean"
PRICES, OPEN = "us long, price double", "us long, match_key long"


def settle(prices: pd.DataFrame, open_: pd.DataFrame, first: tuple[int, float] | None, watermark: int) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """What a pair's state allows at a watermark: closed matches (match_key, us, close, flagged), the prices and the open matches that stay.

    prices: us, price in the order in which ties count; open_: us (the start), match_key; first:
    the earliest price. Times are whole microseconds. A match whose start the watermark has
    passed gets the last price before it, for none of those can still come; without one, the
    first price at all, flagged, once nothing earlier can come either. Of prices only those
    stay that an open or coming match may need: from the watermark on, and the last before it.
    """
    prices, open_ = prices.sort_values(["us", "price"], kind="stable"), open_.sort_values(["us", "match_key"], kind="stable")
    met = pd.merge_asof(open_, prices, on="us", allow_exact_matches=False)
    over = met["us"] <= watermark
    sure = first is not None and first[0] <= watermark
    flagged = met["price"].isna()
    done = over & (~flagged | sure)
    closed = met.assign(close=met["price"].fillna(first[1] if sure else float("nan")), flagged=flagged).loc[done, ["match_key", "us", "close", "flagged"]]
    old = prices["us"] < watermark
    return closed, pd.concat((prices[old].tail(1), prices[~old])), met.loc[~done, ["us", "match_key"]]


class _Closing(StatefulProcessor):
    """A pair's prices and open matches as lists; a timer for each time at which something may close."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.prices, self.open, self.first = handle.getListState("prices", PRICES), handle.getListState("open", OPEN), handle.getValueState("first", PRICES)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for new in rows:
            matches = new["match_key"].notna()
            if matches.any():
                self.open.appendList(_tuples(new.loc[matches, ["us", "match_key"]].astype("int64")))
            priced = new.loc[~matches, ["us", "price"]].astype({"us": "int64"}).sort_values(["us", "price"])
            if len(priced):
                self.prices.appendList(_tuples(priced))
                least = (int(priced["us"].iloc[0]), float(priced["price"].iloc[0]))
                self.first.update(min(least, tuple(self.first.get())) if self.first.exists() else least)
        return self._close(timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._close(timerValues)

    def _close(self, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        watermark = max(0, timerValues.getCurrentWatermarkInMs()) * 1000
        prices, open_ = _frame(self.prices, PRICES), _frame(self.open, OPEN)
        first = tuple(self.first.get()) if self.first.exists() else None
        closed, kept, still = settle(prices, open_, first, watermark)
        for state, before, after in ((self.prices, prices, kept), (self.open, open_, still)):
            if len(after) != len(before):
                state.clear()
                if len(after):
                    state.put(_tuples(after))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        # The next time at which a match may close: its start, or the first price where none is before it.
        if len(still) and first is not None:
            again = max(int(still["us"].min()), first[0] if first[0] >= int(still["us"].min()) else 0)
            self.handle.registerTimer(max(-(-again // 1000), watermark // 1000 + 1))
        yield pd.DataFrame({"match_key": closed["match_key"].astype("int64"), "start": pd.to_datetime(closed["us"], unit="us"), "close": closed["close"].astype(float), "flagged": closed["flagged"].astype(bool)})

    def close(self) -> None:
        pass


def _tuples(rows: pd.DataFrame) -> list[tuple]:
    return list(rows.itertuples(index=False, name=None))


def _frame(state, schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    held = list(state.get()) if state.exists() else []
    return pd.DataFrame(held, columns=names).astype({"us": "int64"})


#: What Spark's keyed state with timers needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def closes_by_state(matches: DataFrame, prices: DataFrame, late: str = "1 hour") -> DataFrame:
    """match_key, start, close, flagged of a match stream (match_key, pair, start) and a price stream (pair, ts, price), each once.

    A match closes when the watermark passes its start, so prices at or after it, compared by
    the microsecond, never set the close, nor do those that come later than late. A pair's
    state holds what settle() keeps; an event-time timer wakes it. Of prices of one time the
    greatest counts before the start, and the least as the first. A match without any price stays
    open until one comes. The session's state store has to be RocksDB (STATE_STORE).
    """
    spark = matches.sparkSession
    if spark.conf.get(STATE_STORE[0], "") != STATE_STORE[1]:
        raise ValueError(f"closes_by_state needs {STATE_STORE[0]} to be {STATE_STORE[1]}")
    ship(spark)
    m = matches.select("pair", F.col("start").alias("ts"), "match_key", F.lit(None).cast("double").alias("price"))
    p = prices.select("pair", "ts", F.lit(None).cast("long").alias("match_key"), "price")
    both = m.unionByName(p).where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    # Spark also sets the processor up beside the driver, where shipped files are not on the path: it travels by value.
    here = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(here)
    try:
        return both.groupBy("pair").transformWithStateInPandas(_Closing(), CLOSED, "Append", "EventTime")
    finally:
        cloudpickle.unregister_pickle_by_value(here)


def fold(joined: DataFrame) -> DataFrame:
    """match_key, close, flagged of the joined rows, as the batch operator has them."""
    return choose(joined, ["match_key"], "start", "ts", F.col("price"), [F.col("price")])


def windows(stream: DataFrame, ts: str, width: str, late: str, keys: Sequence[str]) -> DataFrame:
    """Counts by event-time window and keys under a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
