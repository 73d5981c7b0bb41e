"""Streams driven to completion over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.plans.base import SQL, access_events, scan_results
from tessera.sources.lake_queries import scratch
from tessera.streaming import streams as S

STORE = "spark.sql.streaming.stateStore.providerClass"
RECURSIVE = SQL.replace("WITH", "WITH RECURSIVE", 1)
COLUMNS = "event_id long, event_time timestamp, user_name string, action string, success boolean, doc_id long"


def staged(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, DataFrame]:
    """Events written as files of a stream, in time order, and the stream."""
    at = scratch(spark, name)
    e = access_events(spark, sf_dir).select("event_id", "event_time", "user_name", "action", "success", "doc_id")
    e.repartitionByRange(4, "event_time").write.parquet(f"{at}/in")
    return at, S.source(spark, f"{at}/in", COLUMNS)


@query("stream_ingest", SQL + "SELECT event_id, action FROM access WHERE action IN ('read', 'write', 'delete', 'rename', 'permission_change', 'execute')")
def stream_ingest(spark, sf_dir):
    """Known actions appended to a table, exactly once by the checkpoint."""
    at, e = staged(spark, sf_dir, "ingest")
    S.drain(e.where(F.col("action").isin(*S.ACTIONS)), f"{at}/cp", f"{at}/out")
    S.drain(e.where(F.col("action").isin(*S.ACTIONS)), f"{at}/cp", f"{at}/out")  # nothing is new
    return spark.read.parquet(f"{at}/out").select("event_id", "action")


@query("stream_enrich", SQL + "SELECT a.event_id, s.file_path, s.risk_tier FROM access a JOIN scan s USING (doc_id)")
def stream_enrich(spark, sf_dir):
    """A stream joined to the monitored files."""
    at, e = staged(spark, sf_dir, "enrich")
    m = scan_results(spark, sf_dir).select("doc_id", "file_path", "risk_tier")
    S.drain(S.enriched(e, m, "doc_id").select("event_id", "file_path", "risk_tier"), f"{at}/cp", f"{at}/out")
    return spark.read.parquet(f"{at}/out")


@query("stream_dedup", SQL + ", d AS (SELECT DISTINCT event_id, user_name FROM access) SELECT event_id, user_name, false AS later FROM d UNION ALL SELECT event_id, user_name, true FROM d WHERE event_id % 7 = 0")
def stream_dedup(spark, sf_dir):
    """Replays within 300 seconds are dropped (every tenth event comes again 100 seconds later); an identity that comes again
    when its window is over (every seventh, 60 days later, after the stream has moved on) is an event of its own."""
    at = scratch(spark, "dedup")
    e = access_events(spark, sf_dir).select("event_id", "event_time", "user_name")
    last = e.agg(F.max("event_time")).first()[0]
    later = lambda df, days, seconds=0: df.withColumn("event_time", F.col("event_time") + F.make_dt_interval(days=F.lit(days), secs=F.lit(seconds)))
    beat = later(spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(last).cast("timestamp").alias("event_time"), F.lit("beat").alias("user_name")), 20)
    parts = (e.unionByName(later(e.where("event_id % 10 = 0"), 0, 100)).unionByName(beat), later(e.where("event_id % 7 = 0"), 60))
    for part in parts:
        part.write.mode("append").parquet(f"{at}/in")
        S.drain(S.deduplicated(S.source(spark, f"{at}/in", "event_id long, event_time timestamp, user_name string"), ("event_id", "user_name")), f"{at}/cp", f"{at}/out")
    out = spark.read.parquet(f"{at}/out").where("event_id >= 0")
    return out.select("event_id", "user_name", (F.col("event_time") > F.lit(last).cast("timestamp") + F.make_dt_interval(days=F.lit(10))).alias("later"))


@query("stream_tumbling_window", SQL + "SELECT time_bucket(interval 6 hour, event_time) AS start, action, count(*) AS n FROM access GROUP BY 1, 2")
def stream_tumbling_window(spark, sf_dir):
    at, e = staged(spark, sf_dir, "tumbling")
    S.drain(S.windowed(e, size="6 hours"), f"{at}/cp", each=lambda df, i: df.write.mode("overwrite").parquet(f"{at}/out"), mode="complete")
    return spark.read.parquet(f"{at}/out")


@query("stream_last_event_per_file", SQL + "SELECT doc_id, count(*) AS n, max(event_time) AS last_event FROM access GROUP BY 1")
def stream_last_event_per_file(spark, sf_dir):
    """Running count and last event of each file."""
    at, e = staged(spark, sf_dir, "last")
    S.drain(e.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("event_time").alias("last_event")), f"{at}/cp", each=lambda df, i: df.write.mode("overwrite").parquet(f"{at}/out"), mode="complete")
    return spark.read.parquet(f"{at}/out")


TRIGGER = SQL + """, ev AS (SELECT a.event_time, s.file_path, s.risk_tier, case s.risk_tier when 'CRITICAL' then 2 when 'HIGH' then 5 else 30 end AS gap FROM access a JOIN scan s USING (doc_id) WHERE s.risk_tier IN ('CRITICAL', 'HIGH', 'MEDIUM')),
 m AS (SELECT *, case when epoch(event_time) - epoch(lag(event_time) OVER (PARTITION BY file_path ORDER BY event_time)) < gap then 0 else 1 end AS first FROM ev), g AS (SELECT *, sum(first) OVER (PARTITION BY file_path ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS burst FROM m)"""


@query("scan_trigger_debounce", TRIGGER + " SELECT file_path, risk_tier, max(event_time) + interval 1 second * max(gap) AS due, count(*) AS n FROM g GROUP BY file_path, risk_tier, burst")
def scan_trigger_debounce(spark, sf_dir):
    """Bursts of events on a file end when it has rested for its tier: the session's end is the due time."""
    m = scan_results(spark, sf_dir).select("doc_id", "file_path", "risk_tier")
    return S.triggers(S.enriched(access_events(spark, sf_dir), m, "doc_id")).select("file_path", "risk_tier", "due", "n")


#: Greedy by file: the first time, then each first one at least a minute after the last.
GREEDY = " r AS (SELECT file_path, min(sec) AS sec FROM d GROUP BY 1 UNION ALL SELECT d.file_path, min(d.sec) FROM r JOIN d ON d.file_path = r.file_path AND d.sec >= r.sec + 60 GROUP BY 1)"


@query("scan_trigger_cooldown", TRIGGER.replace("WITH", "WITH RECURSIVE", 1) + ", d AS (SELECT file_path, epoch(max(event_time)) + max(gap) AS sec FROM g GROUP BY file_path, risk_tier, burst)," + GREEDY + " SELECT file_path, make_timestamp((sec * 1000000)::bigint) AS due FROM r")
def scan_trigger_cooldown(spark, sf_dir):
    """Due scans without those within a minute of the file's last one."""
    m = scan_results(spark, sf_dir).select("doc_id", "file_path", "risk_tier")
    due = S.triggers(S.enriched(access_events(spark, sf_dir), m, "doc_id")).select("file_path", "due")
    return S.dispatched(due)


def cooled_stream(spark: SparkSession, sf_dir: str, name: str, cooldown: float) -> DataFrame:
    """Every file's events through the stateful cooldown; the state is checkpointed."""
    at, e = staged(spark, sf_dir, name)
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        keyed = e.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("file_path"), F.floor(F.unix_micros("event_time") / 1e6).cast("double").alias("at"))
        out = keyed.groupBy("file_path").transformWithStateInPandas(S.Cooldown(cooldown), "file_path string, at double", "Append", "None")
        S.drain(out, f"{at}/cp", f"{at}/out")
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return spark.read.parquet(f"{at}/out").withColumnRenamed("at", "sec")


@query("stream_stateful_cooldown", SQL + """, r AS (SELECT DISTINCT doc_id, floor(epoch(event_time)) AS sec FROM access) SELECT doc_id::varchar AS file_path, min(sec)::double AS sec FROM r GROUP BY 1""")
def stream_stateful_cooldown(spark, sf_dir):
    """A cooldown longer than the data: each file passes once, at its first event."""
    return cooled_stream(spark, sf_dir, "cooldown", 1e9)


@query("stream_cooldown_all_files", RECURSIVE + ", d AS (SELECT DISTINCT doc_id::varchar AS file_path, floor(epoch(event_time))::double AS sec FROM access)," + GREEDY + " SELECT file_path, sec FROM r")
def stream_cooldown_all_files(spark, sf_dir):
    """Dispatches of every file with the production cooldown: a file passes again once COOLDOWN seconds are over."""
    return cooled_stream(spark, sf_dir, "cooldown_all", S.COOLDOWN)
