"""Scan triggers as one stateful stream: rest by file, cooldown by file, then a rate limit over all files.

Two processors in a row, both on event time, so a result depends on the events alone and not on how they were dealt
to batches, and a restart goes on from the checkpoint:

- `FileRest`, by file. An event starts or prolongs the file's burst; when the file has rested for its tier, the burst
  is a scan that is due. Events within `cooldown` seconds after a due scan are ignored.
- `RateLimit`, over all files. At most `most` scans are dispatched in any `seconds`; of those that are ready at one
  moment higher tiers go first, then the earlier due, then the path; the others are ready again `retry` seconds later.

Events wait in state until the watermark has passed them and are then taken in order of time, so those that arrive out
of order within the lateness count as if in order. The limit is one key by its nature: it sees bursts of files of
tier MEDIUM or above, not events, and its state is the scans that wait and the last `most` dispatches. The cooldown
runs from the time a scan is due, which the file's own state knows; from the dispatch, every file would have to wait
for the one task of the limit.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessera import taxonomy as X
from tessera.streaming.streams import COOLDOWN, DEBOUNCE, RATE, RATE_SECONDS, RETRY

#: Which goes first.
PRIORITY = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2}
SECOND = 1_000_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def bursts(events: list[tuple[int, int]], open_: tuple[int, int, int, int] | None, quiet: int, until: int, cooldown: int):
    """Fold (time, rest) events, in order, into a file's state: due bursts (first, last, due, n), the open one, end of quiet.

    All times are microseconds; `until` is how far time is known to be complete.
    """
    done = []

    def close(now: int) -> None:
        nonlocal open_, quiet
        if open_ is not None and open_[2] <= now:
            done.append(open_)
            quiet, open_ = open_[2] + cooldown, None

    for at, rest in sorted(events):
        close(at)
        if at >= quiet:
            open_ = (open_[0] if open_ else at, at, at + rest, open_[3] + 1 if open_ else 1)
    close(until)
    return done, open_, quiet


class Places:
    """Which of `n` places are taken, as bits: taking, leaving and finding the next taken one don't go through the others."""

    def __init__(self, n: int):
        self.width = max(64, math.isqrt(n))
        self.words, self.used = [0] * (n // self.width + 1), 0

    def take(self, i: int) -> None:
        word, bit = divmod(i, self.width)
        self.words[word] |= 1 << bit
        self.used |= 1 << word

    def leave(self, i: int) -> None:
        word, bit = divmod(i, self.width)
        self.words[word] &= ~(1 << bit)
        if not self.words[word]:
            self.used &= ~(1 << word)

    def next(self, i: int) -> int | None:
        """The first taken place from i on."""
        word, bit = divmod(i, self.width)
        if ahead := self.words[word] >> bit:
            return i + (ahead & -ahead).bit_length() - 1
        if ahead := self.used >> word + 1:
            word += (ahead & -ahead).bit_length()
            return word * self.width + (self.words[word] & -self.words[word]).bit_length() - 1
        return None


def limited(waiting: list[tuple], sent: list[int], until: int, most: int, seconds: int, retry: int):
    """Dispatch of (ready, rank, due, path, n): those dispatched with their time, those that wait, the times within the window.

    A scan that waits is ready again every `retry`, so always at the same place of that period: once there is room, the
    next scan is the one at the next place. Moments at which nothing can be dispatched are passed over, so the work
    grows with the scans and not with how long they wait.
    """
    coming, later = sorted(w for w in waiting if w[0] <= until), [w for w in waiting if w[0] > until]
    places = sorted({w[0] % retry for w in coming})
    taken, here = Places(len(places)), [[] for _ in places]
    done, sent, come, now = [], sorted(sent), 0, coming[0][0] - 1 if coming else until
    while most > 0:
        # the first moment with room, and all that have come by then
        now = max(now + 1, sent[-most] + seconds) if len(sent) >= most else now + 1
        ahead = taken.next(bisect_left(places, now % retry))
        turn = 0 if ahead is not None else retry
        if ahead is None:
            ahead = taken.next(0)
        ready = None if ahead is None else now - now % retry + turn + places[ahead]
        if come < len(coming) and (ready is None or coming[come][0] <= ready):
            # one that comes before or just then takes its place; the next moment is sought again
            first = max(now, coming[come][0])
            while come < len(coming) and coming[come][0] <= first:
                at = bisect_left(places, coming[come][0] % retry)
                heapq.heappush(here[at], coming[come][1:])
                taken.take(at)
                come += 1
            now = first - 1
            continue
        if ready is None or ready > until:
            break
        now, room = ready, most - len(sent) + bisect_right(sent, ready - seconds)
        while room > 0 and here[ahead]:
            done.append((now, *heapq.heappop(here[ahead]), now))
            insort(sent, now)
            room -= 1
        if not here[ahead]:
            taken.leave(ahead)
    again = lambda place: until + 1 + (place - until - 1) % retry
    left = [(again(p), *scan) for p, scans in zip(places, here) for scan in scans] + [(again(w[0]), *w[1:]) for w in coming[come:]] + later
    return done, left, sent[-most:] if most > 0 else []


def _milli(micro: int) -> int:
    return -(-micro // 1000)


def _times(micros: tuple[int, ...]) -> pd.Series:
    """As microseconds: scans that wait for their turn may be dispatched after 2262, where nanoseconds end."""
    return pd.Series(np.array(micros, "datetime64[us]"))


class FileRest(StatefulProcessor):
    """file_path, risk_tier, due, first, last, n of each burst once its file has rested."""

    SCHEMA = "file_path string, risk_tier string, due timestamp, first timestamp, last timestamp, n long"

    def __init__(self, cooldown: float = COOLDOWN):
        self.cooldown = int(cooldown * SECOND)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, rest long")
        self.burst = handle.getValueState("burst", "first long, last long, due long, n long")
        self.quiet = handle.getValueState("quiet", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(rows)
        self.waiting.appendList([(int(a), int(r)) for a, r in zip(got["at"], got["rest"])])
        self.handle.registerTimer(_milli(int(got["at"].min())))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        events = [(r[0], r[1]) for r in self.waiting.get()] if self.waiting.exists() else []
        ready, later = [e for e in events if e[0] <= until], [e for e in events if e[0] > until]
        was = tuple(self.burst.get()) if self.burst.exists() else None
        quiet = self.quiet.get()[0] if self.quiet.exists() else 0
        done, burst, quiet = bursts(ready, was, quiet, until, self.cooldown)
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        self.burst.update(burst) if burst else self.burst.clear()
        moments = [e[0] for e in later] + ([burst[2]] if burst else [])
        if moments or quiet > until:
            self.quiet.update((quiet,))
            self.handle.registerTimer(_milli(min(moments or [quiet])))
        else:
            self.quiet.clear()  # nothing of a file at rest is kept
        if done:
            first, last, due, n = zip(*done)
            yield pd.DataFrame({"file_path": key[0], "risk_tier": key[1], "due": _times(due), "first": _times(first), "last": _times(last), "n": n})

    def close(self) -> None:
        pass


class RateLimit(StatefulProcessor):
    """The due scans as they are dispatched."""

    SCHEMA = "file_path string, risk_tier string, due timestamp, dispatched timestamp, n long"

    def __init__(self, most: int = RATE, seconds: float = RATE_SECONDS, retry: float = RETRY):
        self.most, self.seconds, self.retry = most, int(seconds * SECOND), int(retry * SECOND)
        self.tiers = {v: k for k, v in PRIORITY.items()}

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ready long, rank int, due long, file_path string, n long")
        self.sent = handle.getListState("sent", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(rows)
        due = [int(x) for x in got["at"]]
        self.waiting.appendList([(d, PRIORITY[t], d, f, int(n)) for d, t, f, n in zip(due, got["risk_tier"], got["file_path"], got["n"])])
        self.handle.registerTimer(max(_milli(min(due)), timerValues.getCurrentWatermarkInMs()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        sent = [r[0] for r in self.sent.get()] if self.sent.exists() else []
        done, waiting, now = limited(waiting, sent, until, self.most, self.seconds, self.retry)
        if not done and not waiting:
            return
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        if now:
            self.sent.put([(t,) for t in now])
        if waiting:
            self.handle.registerTimer(_milli(min(w[0] for w in waiting)))
        if done:
            _, rank, due, path, n, at = zip(*done)
            yield pd.DataFrame({"file_path": path, "risk_tier": [self.tiers[r] for r in rank], "due": _times(due), "dispatched": _times(at), "n": n})

    def close(self) -> None:
        pass


def scan_trigger(
    events: DataFrame, late: str = "60 seconds", cooldown: float = COOLDOWN, most: int = RATE, seconds: float = RATE_SECONDS, retry: float = RETRY,
) -> DataFrame:
    """Dispatched scans of a stream of events (event_time, file_path, risk_tier). Needs the RocksDB state store (ROCKS).

    An event of 2262 or later, which pandas can't hold, only moves the watermark: a stream ends by such a beat.
    """
    rest = X.literal_map(DEBOUNCE)[F.col("risk_tier")] * SECOND
    keyed = events.where(F.col("risk_tier").isin(*PRIORITY)).withWatermark("event_time", late)
    keyed = keyed.where(F.col("event_time") < F.lit("2262-01-01").cast("timestamp")).select("file_path", "risk_tier", "event_time", F.unix_micros("event_time").alias("at"), rest.cast("long").alias("rest"))
    due = keyed.groupBy("file_path", "risk_tier").transformWithStateInPandas(FileRest(cooldown), FileRest.SCHEMA, "Append", "EventTime", eventTimeColumnName="due")
    due = due.select(F.lit(0).alias("all"), "file_path", "risk_tier", "due", F.unix_micros("due").alias("at"), "n")
    return due.groupBy("all").transformWithStateInPandas(RateLimit(most, seconds, retry), RateLimit.SCHEMA, "Append", "EventTime")


def stateful(spark: SparkSession) -> SparkSession:
    """A session of its own for the stream, with the state store that its processors need; the caller's stays as it is."""
    own = spark.newSession()
    own.conf.set(STORE, ROCKS)
    return own
