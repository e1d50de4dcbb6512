"""Stitching of fragments as a stream: chains as ``operators.stitch.chains`` finds them, with fragments in any order.

State is kept by station: fragments that wait for earlier ones, and the chain that
is open.  A fragment waits until ``hold`` of event time has passed after it;
then its station's waiting fragments are joined in order.  One that comes
after its turn is given out as late and changes no chain.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sondeframe.operators.stitch import LOWEST_RESTART

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "station string, profile_seq long, profile_id string, chain long, late boolean"

Fragment = tuple[str, float | None, float | None, int | None]  # id, bottom, top, hour
Chain = tuple[int, float | None, int | None]  # first number, top, hour


def join(chain: Chain | None, seq: int, fragment: Fragment, tolerance: float) -> Chain:
    """The chain after a fragment: the same one longer, or a new one."""
    _, bottom, top, hour = fragment
    on = chain is not None and bottom is not None and chain[1] is not None and bottom > LOWEST_RESTART and abs(bottom - chain[1]) <= tolerance and (chain[2] is None or hour is None or chain[2] == hour)
    if bottom is None or top is None:
        reach = None
    else:
        reach = max(chain[1], top) if on else top
    return (chain[0], reach, chain[2]) if on else (seq, reach, hour)


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


class Stitcher(StatefulProcessor):
    """Waiting fragments by (time, number), the open chain, and the place up to which chains are done."""

    def __init__(self, tolerance: float, hold: int, keep: int) -> None:
        self.tolerance, self.hold, self.keep = tolerance, hold, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "time long, seq long", "id string, bottom double, top double, hour long")
        self.chain = handle.getValueState("chain", "chain long, top double, hour long")
        self.done = handle.getValueState("done", "time long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = tuple(self.done.get()) if self.done.exists() else None
        late = []
        for part in rows:
            for r in part.itertuples(index=False):
                place = (int(r.time), int(r.profile_seq))
                if done is not None and place <= done:
                    late.append((key[0], place[1], r.profile_id, None, True))
                    continue
                self.waiting.updateValue(place, (r.profile_id, _number(r.bottom), _number(r.top), None if pd.isna(r.hour) else int(r.hour)))
                self.handle.registerTimer(max(1, place[0] + self.hold - self.keep))
        yield self._rows(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() + self.keep - self.hold  # fragments up to here have waited long enough
        ready = sorted((tuple(place), tuple(fragment)) for place, fragment in self.waiting.iterator() if place[0] <= now)
        chain = tuple(self.chain.get()) if self.chain.exists() else None
        out = []
        for place, fragment in ready:
            chain = join(chain, place[1], fragment, self.tolerance)
            out.append((key[0], place[1], fragment[0], chain[0], False))
            self.waiting.removeKey(place)
        if ready:
            self.chain.update(chain)
            self.done.update(ready[-1][0])
            self.handle.registerTimer(ready[-1][0][0] + self.keep)
        elif self.done.exists() and not any(True for _ in self.waiting.keys()) and self.done.get()[0] + self.keep <= timerValues.getCurrentWatermarkInMs():
            # nothing can come before the place that is done any more, and its ascent is long over
            self.chain.clear()
            self.done.clear()
        yield self._rows(out)

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["station", "profile_seq", "profile_id", "chain", "late"])
        return frame.astype({"profile_seq": "int64", "chain": "Int64", "late": "bool"})


def stitched(fragments: DataFrame, tolerance: float = 500.0, hold: datetime.timedelta = datetime.timedelta(hours=6), keep: datetime.timedelta = datetime.timedelta(days=2)) -> DataFrame:
    """(station, profile_seq, profile_id, chain, late) of a stream of fragments.

    ``fragments``: station, profile_seq, profile_id, bottom, top, date (may be
    null) and event_time (a timestamp, never null, that rises with profile_seq
    within a station).  Chains follow the order of (event_time, profile_seq).  A
    fragment that comes within ``hold`` of event time after later ones is put in
    its place; one that comes later still has ``late`` true and no chain; after
    ``keep`` Spark drops it and counts it among the rows dropped by watermark.
    A chain ends with its ascent: after ``keep`` without a fragment it is
    forgotten, so that state holds open ascents and waiting fragments alone.
    """
    spark = fragments.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    if keep < hold:
        raise ValueError("keep must be as long as hold at least")
    millis = lambda t: int(t.total_seconds() * 1000)
    rows = fragments.withWatermark("event_time", f"{millis(keep)} milliseconds").select(
        F.col("station").cast("string").alias("station"), F.col("profile_seq").cast("long").alias("profile_seq"), F.col("profile_id").cast("string").alias("profile_id"),
        F.col("bottom").cast("double").alias("bottom"), F.col("top").cast("double").alias("top"),
        F.unix_millis(F.date_trunc("hour", F.col("date").cast("timestamp"))).alias("hour"), F.unix_millis("event_time").alias("time"), "event_time",
    )
    return rows.groupBy("station").transformWithStateInPandas(Stitcher(tolerance, millis(hold), millis(keep)), OUTPUT, "Append", "EventTime")


def land_stitched(spark: SparkSession, fragments: DataFrame, target: str, checkpoint: str, once: bool = False, **options) -> StreamingQuery:
    """Write chains and late fragments of a stream under ``target``, in folders ``chains`` and ``late``, each batch in a folder of its own.

    A batch run again after a loss overwrites its folders.
    """

    def write(rows: DataFrame, batch: int) -> None:
        held = rows.persist()
        held.filter("not late").drop("late").write.mode("overwrite").parquet(f"{target}/chains/batch={batch}")
        held.filter("late").select("station", "profile_seq", "profile_id").write.mode("overwrite").parquet(f"{target}/late/batch={batch}")
        held.unpersist()

    writer = stitched(fragments, **options).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
