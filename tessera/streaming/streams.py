"""Event streams: ingest, enrichment, replay dedup, debounced scan triggers, windows. State is checkpointed event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import taxonomy as X

#: Actions that count, and how long a file rests before its scan, by tier.
ACTIONS = ("read", "write", "delete", "rename", "permission_change", "execute")
DEBOUNCE = {"CRITICAL": 2, "HIGH": 5, "MEDIUM": 30, "LOW": 30, "MINIMAL": 30}
COOLDOWN, RATE, RATE_SECONDS, RETRY = 60, 10, 60, 5
#: Times of a file that are Python numbers at once.
PART = 50_000


def source(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they arrive; the limit per trigger is the back-pressure."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def enriched(events: DataFrame, monitored: DataFrame, key: str = "file_path") -> DataFrame:
    """Events with a known action on monitored files, with the file's columns."""
    return events.where(F.col("action").isin(*ACTIONS)).join(monitored, key)


def deduplicated(events: DataFrame, columns: tuple[str, ...], time: str = "event_time", window: str = "300 seconds") -> DataFrame:
    """Without replays: an event with the identity of one seen within the window is dropped."""
    return events.withColumn("identity", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)).withWatermark(time, window).dropDuplicatesWithinWatermark(["identity"])


def gap(tier: Column) -> Column:
    """A file's rest as an interval expression."""
    return F.concat(F.coalesce(X.literal_map(DEBOUNCE)[tier], F.lit(30)).cast("string"), F.lit(" seconds"))


def triggers(events: DataFrame, time: str = "event_time", key: str = "file_path", tier: str = "risk_tier", late: str = "60 seconds") -> DataFrame:
    """One scan per burst of events on a file of tier MEDIUM or above, due when the file has rested for its tier."""
    e = events.where(X.tier_ordinal(F.col(tier)) >= X.TIER_ORDER["MEDIUM"]).withWatermark(time, late)
    s = e.groupBy(key, tier, F.session_window(time, gap(F.col(tier))).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, tier, F.col("w.start").alias("first"), F.col("w.end").alias("due"), "n")


def cooled(due: Iterator[tuple[str, float]], cooldown: float = COOLDOWN) -> list[bool]:
    """Whether each of a file's due times (in order) is dispatched: not within the cooldown of the last dispatch."""
    last, out = None, []
    for _, at in due:
        ok = last is None or at - last >= cooldown
        out.append(ok)
        last = at if ok else last
    return out


def dispatched(due: DataFrame, key: str = "file_path", cooldown: float = COOLDOWN) -> DataFrame:
    """Batch or foreachBatch: the due scans that the per-file cooldown lets through."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("due")
        at = rows["due"].astype("int64") / 1e9 if rows["due"].dtype.kind == "M" else rows["due"]
        return rows[cooled(zip(rows[key], at), cooldown)]

    return due.groupBy(key).applyInPandas(run, due.schema)


def windowed(events: DataFrame, time: str = "event_time", size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ("action",)) -> DataFrame:
    """Counts by window; slide makes the windows overlap, events later than the watermark are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


class Cooldown:
    """A stateful processor for transformWithStateInPandas: passes a file's event if the last pass is `cooldown` seconds ago."""

    def __new__(cls, cooldown: float = COOLDOWN):
        from pyspark.sql.streaming import StatefulProcessor

        class Processor(StatefulProcessor):
            def init(self, handle) -> None:
                self.last = handle.getValueState("last", "at double")

            def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
                times = np.sort(np.concatenate([r["at"].to_numpy() for r in rows]))
                last = self.last.get()[0] if self.last.exists() else None
                for i in range(0, len(times), PART):
                    passed = []
                    for at in times[i : i + PART].tolist():
                        if last is None or at - last >= cooldown:
                            last = at
                            passed.append(at)
                    if passed:  # one frame for many passes: a frame costs more than thousands of rows
                        yield pd.DataFrame({"file_path": key[0], "at": passed})
                if last is not None:
                    self.last.update((last,))

            def close(self) -> None:
                pass

        return Processor()


def drain(df: DataFrame, checkpoint: str, path: str | None = None, each: Callable[[DataFrame, int], Any] | None = None, mode: str = "append") -> None:
    """Run a stream over all that is there, once (AvailableNow); the checkpoint lets the next run go on."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(each) if each else w.format("parquet").option("path", path)).start()
    q.awaitTermination()
