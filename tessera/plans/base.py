"""The engine's fact tables derived from the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.session import shared_place, spread, table

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"\+[0-9][ ().0-9-]{8,}[0-9]"
IP = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
NOW = "2024-01-31 00:00:00"


_kept: dict[tuple, str] = {}
_keeping = threading.Lock()


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: what tells whether it has changed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found, out = fs.listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def kept(spark: SparkSession, sf_dir: str, name: str, sources: tuple[str, ...], derive: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written to the engine's shared folder once for the state its sources are in, and read from there.

    Scans write what they find once; dashboards, policies and exports read columns of it and no text.
    """
    state = tuple(fingerprint(spark, f"{sf_dir.rstrip('/')}/{t}.parquet") for t in sources)
    key = (spark.sparkContext.applicationId, name, state)
    with _keeping:
        if key not in _kept:
            path = shared_place(spark, name)
            derive().write.parquet(path)
            _kept[key] = path
    return spark.read.parquet(_kept[key])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a scanned file: path, exposure, owner, dates, counts of each entity. Scanned once, see `kept`."""
    return kept(spark, sf_dir, "files", ("documents",), lambda: scanned(spread(table(spark, sf_dir, "documents"))))


def scanned(d: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    # cheap tests first: most documents have none of these
    count = lambda test, pattern: F.when(test, F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).otherwise(0)
    card = F.expr("size(filter(regexp_extract_all(coalesce(text, ''), '[0-9]{13,}', 0), v -> length(v) <= 19 and luhn_check(v)))")
    out = d.select(
        "doc_id", F.col("lang").alias("tenant"), "source", F.col("n_chars").alias("file_size"),
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.concat(F.lit("user"), (F.col("doc_id") % 17).cast("string")).alias("owner"),
        F.element_at(F.array(*map(F.lit, ("PRIVATE", "INTERNAL", "ORG_WIDE", "PUBLIC"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("exposure_level"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("scan_date"),
        count(F.col("text").contains("@"), EMAIL).alias("n_email"), count(F.col("text").contains("+"), PHONE).alias("n_phone"),
        count(F.col("text").rlike(r"[0-9]\."), IP).alias("n_ip"), F.when(F.col("text").rlike("[0-9]{13}"), card).otherwise(0).alias("n_card"),
    )
    kinds = (("CREDIT_CARD", "n_card"), ("EMAIL", "n_email"), ("IP_ADDRESS", "n_ip"), ("PHONE", "n_phone"))
    entries = F.filter(F.array(*[F.struct(F.lit(t).alias("key"), F.col(c).alias("value")) for t, c in kinds]), lambda e: e["value"] > 0)
    out = out.withColumn("entity_counts", F.map_from_entries(entries)).withColumn("total_entities", sum(F.col(c) for _, c in kinds).cast("long"))
    return out.select("*", *scoring.score_columns(F.col("entity_counts"), F.col("exposure_level")))


def scan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only sensitive files are persisted as results."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("__label"))
    out = files(spark, sf_dir).where("total_entities > 0").join(labels, "doc_id", "left")
    return out.withColumn("label_applied", F.coalesce("__label", F.lit(False))).drop("__label")


def entities(results: DataFrame) -> DataFrame:
    return results.select("*", F.explode("entity_counts").alias("entity_type", "n"))


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type").isin("view", "click", "error"), "read").when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "signup", "permission_change")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("event_time"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_name"),
        action.alias("action"), (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 997).alias("doc_id"), "value",
    )


LUHN = "list_sum(list_transform(range(1, length(v) + 1), lambda i: case when (length(v) - i) % 2 = 1 then (case when 2 * cast(substr(v, i, 1) as int) > 9 then 2 * cast(substr(v, i, 1) as int) - 9 else 2 * cast(substr(v, i, 1) as int) end) else cast(substr(v, i, 1) as int) end)) % 10 = 0"

SQL = rf"""WITH counted AS (
  SELECT doc_id, lang AS tenant, source, n_chars AS file_size, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS file_path, doc_id || '.txt' AS file_name,
    'user' || (doc_id % 17) AS owner, ['PRIVATE', 'INTERNAL', 'ORG_WIDE', 'PUBLIC'][doc_id % 4 + 1] AS exposure_level, [1.0::double, 1.2::double, 1.8::double, 2.5::double][doc_id % 4 + 1] AS exposure_multiplier,
    date '2024-01-01' + cast(doc_id % 30 as int) AS scan_date,
    len(regexp_extract_all(text, '{EMAIL}')) AS n_email, len(regexp_extract_all(text, '{PHONE}')) AS n_phone, len(regexp_extract_all(text, '{IP}')) AS n_ip,
    len(list_filter(regexp_extract_all(text, '[0-9]{{13,}}'), lambda v: length(v) <= 19 and {LUHN})) AS n_card
  FROM documents),
scored AS (
  SELECT *, n_email + n_phone + n_ip + n_card AS total_entities,
    least(100.0::double, (case when n_card > 0 then 10 * 4.0::double * (1 + ln(n_card)) * 0.85::double else 0 end) + (case when n_email > 0 then 6 * 4.0::double * (1 + ln(n_email)) * 0.85::double else 0 end)
      + (case when n_ip > 0 then 5 * 4.0::double * (1 + ln(n_ip)) * 0.85::double else 0 end) + (case when n_phone > 0 then 6 * 4.0::double * (1 + ln(n_phone)) * 0.85::double else 0 end)) AS content_score
  FROM counted),
files AS (
  SELECT *, least(100.0::double, content_score * exposure_multiplier) AS raw_score,
    cast(round_even(least(100.0::double, content_score * exposure_multiplier), 0) as int) AS risk_score,
    case when least(100.0::double, content_score * exposure_multiplier) >= 80 then 'CRITICAL' when least(100.0::double, content_score * exposure_multiplier) >= 55 then 'HIGH'
      when least(100.0::double, content_score * exposure_multiplier) >= 31 then 'MEDIUM' when least(100.0::double, content_score * exposure_multiplier) >= 11 then 'LOW' else 'MINIMAL' end AS risk_tier
  FROM scored),
scan AS (
  SELECT f.*, coalesce(l.lab, false) AS label_applied FROM files f LEFT JOIN (SELECT doc_id, max(quality) = 1 AS lab FROM labels GROUP BY doc_id) l USING (doc_id) WHERE total_entities > 0),
ents AS (
  SELECT scan.*, 'CREDIT_CARD' AS entity_type, n_card AS n FROM scan WHERE n_card > 0 UNION ALL SELECT scan.*, 'EMAIL', n_email FROM scan WHERE n_email > 0
  UNION ALL SELECT scan.*, 'IP_ADDRESS', n_ip FROM scan WHERE n_ip > 0 UNION ALL SELECT scan.*, 'PHONE', n_phone FROM scan WHERE n_phone > 0),
access AS (
  SELECT event_id, ts AS event_time, 'user' || user_id AS user_name, case when event_type in ('view', 'click', 'error') then 'read' when event_type = 'purchase' then 'write' when event_type = 'signup' then 'permission_change' end AS action,
    event_type <> 'error' AS success, event_id % 997 AS doc_id, value FROM events)
"""
