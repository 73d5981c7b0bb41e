"""The scan trigger as one stateful stream over the events table, and the same as recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.plans.base import SQL, access_events, scan_results
from tessera.sources.lake_queries import scratch
from tessera.streaming import scan_trigger as G
from tessera.streaming import streams as S

#: The limit of `scan_trigger_rate_limit`: so few scans in so long a time that scans of these events wait for each other.
FEW, LONG, AGAIN = 4, 6 * 3600, 3600
EVENTS = "event_time timestamp, doc_id long"


def _sql(most: int, seconds: int, retry: int) -> str:
    """Bursts by file, folded event by event; then the limit, folded moment by moment. Times are microseconds."""
    s = 1_000_000
    return SQL.replace("WITH", "WITH RECURSIVE", 1) + f""", ev AS (
  SELECT s.file_path, s.risk_tier, epoch_us(a.event_time) AS us, case s.risk_tier when 'CRITICAL' then 2 when 'HIGH' then 5 else 30 end * {s}::bigint AS rest,
    row_number() OVER (PARTITION BY s.file_path ORDER BY a.event_time) AS k FROM access a JOIN scan s USING (doc_id) WHERE s.risk_tier IN ('CRITICAL', 'HIGH', 'MEDIUM') AND a.action IS NOT NULL),
b AS (
  SELECT file_path, risk_tier, k, us + rest AS due, 1::bigint AS n, 0::bigint AS quiet, NULL::bigint AS done, NULL::bigint AS done_n FROM ev WHERE k = 1
  UNION ALL
  SELECT file_path, risk_tier, k, case when us >= q then us + rest when not closed then due end, case when us >= q then (case when closed or due is null then 1 else n + 1 end) when not closed then n end,
    q, case when closed then due end, case when closed then n end
  FROM (SELECT b.file_path, b.risk_tier, ev.k, ev.us, ev.rest, b.due, b.n, coalesce(b.due <= ev.us, false) AS closed, case when coalesce(b.due <= ev.us, false) then b.due + {60 * s} else b.quiet end AS q
    FROM b JOIN ev ON ev.file_path = b.file_path AND ev.k = b.k + 1)),
due AS (
  SELECT file_path, risk_tier, done AS due, done_n AS n FROM b WHERE done IS NOT NULL
  UNION ALL SELECT file_path, risk_tier, due, n FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY k DESC) AS back FROM b) WHERE back = 1 AND due IS NOT NULL),
g AS (
  SELECT due AS us, row_number() OVER (ORDER BY due) AS k, list({{'rank': case risk_tier when 'CRITICAL' then 0 when 'HIGH' then 1 else 2 end, 'due': due, 'file': file_path, 'n': n, 'ready': due}}) AS items FROM due GROUP BY due),
lim AS (
  SELECT 1::bigint AS k, [{{'rank': 0, 'due': 0::bigint, 'file': '', 'n': 0::bigint, 'ready': 0::bigint}}][1:0] AS waiting, [0::bigint][1:0] AS sent, [{{'rank': 0, 'due': 0::bigint, 'file': '', 'n': 0::bigint, 'ready': 0::bigint}}][1:0] AS out, 0::bigint AS now
  UNION ALL
  SELECT k + coalesce((us = now)::int, 0), list_filter(waiting, lambda w: w.ready > now) || list_transform(batch[room + 1:], lambda w: {{'rank': w.rank, 'due': w.due, 'file': w.file, 'n': w.n, 'ready': now + {retry * s}}}), live || list_transform(batch[1:room], lambda w: now), batch[1:room], now
  FROM (
    SELECT *, greatest(0, {most} - len(live)) AS room FROM (
      SELECT *, list_filter(sent, lambda t: now - t < {seconds * s}) AS live, list_sort(coalesce(case when us = now then items end, waiting[1:0]) || list_filter(waiting, lambda w: w.ready <= now)) AS batch FROM (
        SELECT lim.k, lim.waiting, lim.sent, g.us, g.items, least(g.us, list_min(list_transform(lim.waiting, lambda w: w.ready))) AS now FROM lim LEFT JOIN g ON g.k = lim.k) WHERE now IS NOT NULL)))
SELECT o.file AS file_path, ['CRITICAL', 'HIGH', 'MEDIUM'][o.rank + 1] AS risk_tier, make_timestamp(o.due) AS due, make_timestamp(now) AS dispatched, o.n AS n FROM (SELECT now, unnest(out) AS o FROM lim)"""


def triggered(spark: SparkSession, sf_dir: str, name: str, most: int, seconds: float, retry: float) -> DataFrame:
    """Every dispatched scan. The stream is stopped half way and started again from its checkpoint."""
    at, own = scratch(spark, name), G.stateful(spark)
    e = access_events(own, sf_dir).where(F.col("action").isNotNull()).select("event_time", "doc_id")
    least, most_time = e.agg(F.min("event_time"), F.max("event_time")).first()
    if least is None:
        return spark.createDataFrame([], G.RateLimit.SCHEMA)
    half = F.lit(least + (most_time - least) / 2)
    e.where(F.col("event_time") <= half).write.parquet(f"{at}/in")
    # the beat of a file that is always there moves the watermark past the last event
    beat = own.createDataFrame([(-1, "/beat", "MEDIUM")], "doc_id long, file_path string, risk_tier string")
    monitored = scan_results(own, sf_dir).select("doc_id", "file_path", "risk_tier").unionByName(beat)
    stream = S.source(own, f"{at}/in", EVENTS).join(monitored, "doc_id")

    def run() -> None:
        S.drain(G.scan_trigger(stream, most=most, seconds=seconds, retry=retry), f"{at}/cp", f"{at}/out")

    run()
    e.where(F.col("event_time") > half).write.mode("append").parquet(f"{at}/in")
    # in any `seconds + retry` after the last event at least `most` of those that wait are dispatched, so by then all are
    scans = e.join(monitored.where(F.col("risk_tier").isin(*G.PRIORITY)), "doc_id").count()
    days = int((scans // most + 1) * (seconds + retry) // 86400) + 2
    own.range(1).select((F.lit(most_time) + F.make_dt_interval(days=F.lit(days))).alias("event_time"), F.lit(-1).cast("long").alias("doc_id")).write.mode("append").parquet(f"{at}/in")
    run()
    return spark.read.schema(G.RateLimit.SCHEMA).parquet(f"{at}/out")


@query("scan_trigger", _sql(S.RATE, S.RATE_SECONDS, S.RETRY))
def scan_trigger(spark, sf_dir):
    """Rest, cooldown and rate limit of production over all events."""
    return triggered(spark, sf_dir, "trigger", S.RATE, S.RATE_SECONDS, S.RETRY)


@query("scan_trigger_rate_limit", _sql(FEW, LONG, AGAIN))
def scan_trigger_rate_limit(spark, sf_dir):
    """The same with a limit that these events reach: higher tiers go first, the others wait."""
    return triggered(spark, sf_dir, "trigger-limit", FEW, LONG, AGAIN)
