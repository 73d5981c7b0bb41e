"""Queries that write the lake and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.plans.base import SQL, access_events, scan_results
from tessera.sources.lake import COMPACT_AT, Lake, extract_text, extracted
from tessera.session import shared_place as scratch
from tessera.session import table


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scan_results(spark, sf_dir)
    return r.select("file_path", "file_name", "file_size", "risk_score", "risk_tier", "content_score", "exposure_multiplier", "exposure_level", "owner", "entity_counts", "total_entities", "label_applied", F.col("scan_date").cast("timestamp").alias("scanned_at"), "tenant", F.col("source").alias("target"), "scan_date", F.md5("file_path").alias("id"))


@query("lake_roundtrip", SQL + "SELECT file_path, risk_score, tenant, source AS target, scan_date, md5(file_path) AS id FROM scan")
def lake_roundtrip(spark, sf_dir):
    """Written by tenant, target and date; read back by the declared schema."""
    lake = Lake(spark, scratch(spark, "roundtrip"))
    lake.append(results(spark, sf_dir), "scan_results")
    return lake.read("scan_results").select("file_path", "risk_score", "tenant", "target", "scan_date", F.lower(F.hex("id")).alias("id"))


@query("lake_partition_pruning", SQL + "SELECT file_path FROM scan WHERE tenant = 'fr' AND scan_date >= date '2024-01-10'")
def lake_partition_pruning(spark, sf_dir):
    lake = Lake(spark, scratch(spark, "pruning"))
    lake.append(results(spark, sf_dir), "scan_results")
    return lake.read("scan_results").where((F.col("tenant") == "fr") & (F.col("scan_date") >= F.lit("2024-01-10").cast("date"))).select("file_path")


@query("lake_snapshot_overwrite", SQL + "SELECT file_path, case when tenant = 'en' then 'second' else 'first' end AS owner FROM scan")
def lake_snapshot_overwrite(spark, sf_dir):
    """A second snapshot of one tenant leaves the others as they are."""
    lake = Lake(spark, scratch(spark, "snapshot"))
    r = results(spark, sf_dir)
    lake.snapshot(r.withColumn("owner", F.lit("first")), "file_inventory")
    lake.snapshot(r.where("tenant = 'en'").withColumn("owner", F.lit("second")), "file_inventory")
    return lake.read("file_inventory").select("file_path", "owner")


@query("lake_incremental_flush", SQL + "SELECT count(*) AS n, count(DISTINCT event_id) AS events, 0::bigint AS again FROM access")
def lake_incremental_flush(spark, sf_dir):
    """Three flushes with a cursor: every event once, and nothing the last time."""
    lake = Lake(spark, scratch(spark, "flush"))
    a = access_events(spark, sf_dir).select(F.col("event_id").cast("string").alias("file_path"), "action", "success", "user_name", "event_time", F.lit("t").alias("tenant"), F.to_date("event_time").alias("event_date"))
    _, at = lake.flush_since(a.where("event_time < timestamp '2024-01-15 00:00:00'"), "access_events", "event_time", None)
    _, at = lake.flush_since(a, "access_events", "event_time", at)
    again, _ = lake.flush_since(a, "access_events", "event_time", at)
    return lake.read("access_events").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("events")).withColumn("again", F.lit(again).cast("long"))


@query("lake_compaction", SQL + f"SELECT {COMPACT_AT} * count(*) AS n, ({COMPACT_AT} * sum(risk_score))::bigint AS s, {COMPACT_AT}::bigint AS before, 1::bigint AS after FROM scan")
def lake_compaction(spark, sf_dir):
    """The small files of a partition become one; its rows stay."""
    lake = Lake(spark, scratch(spark, "compaction"))
    r = results(spark, sf_dir).withColumn("tenant", F.lit("all")).withColumn("target", F.lit("x")).withColumn("scan_date", F.lit("2024-01-01").cast("date"))
    for _ in range(COMPACT_AT):
        lake.append(r.coalesce(1), "scan_results")
    before = max(lake.leaves("scan_results").values())
    lake.compact("scan_results")
    after = max(lake.leaves("scan_results").values())
    return lake.read("scan_results").agg(F.count("*").alias("n"), F.sum("risk_score").alias("s")).select("n", "s", F.lit(before).cast("long").alias("before"), F.lit(after).cast("long").alias("after"))


@query("lake_empty_views", "SELECT 0::bigint AS results, 0::bigint AS events")
def lake_empty_views(spark, sf_dir):
    Lake(spark, scratch(spark, "empty")).views()
    return spark.sql("SELECT (SELECT count(*) FROM scan_results) AS results, (SELECT count(*) FROM access_events) AS events")


@query("lake_catalog_rebuild", SQL + "SELECT 'scan_results' AS name, count(*) AS n FROM scan UNION ALL SELECT 'access_events', count(*) FROM access")
def lake_catalog_rebuild(spark, sf_dir):
    """All tables exported anew."""
    lake = Lake(spark, scratch(spark, "rebuild"))
    lake.append(results(spark, sf_dir), "scan_results")
    a = access_events(spark, sf_dir).select(F.col("event_id").cast("string").alias("file_path"), "action", "success", "user_name", "event_time", F.lit("t").alias("tenant"), F.to_date("event_time").alias("event_date"))
    lake.append(a, "access_events")
    n = [lake.read(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("scan_results", "access_events")]
    return n[0].unionByName(n[1])


@query("extract_html", "SELECT page_id, true AS has_text FROM pages")
def extract_html(spark, sf_dir):
    """Text of pages by the file reader: no scripts, no markup."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/p/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "utf-8").alias("content"))
    x = extracted(p.select("path", "content"))
    return x.select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("page_id"), ((F.length("text") > 0) & ~F.contains("text", F.lit("track(")) & F.col("error").isNull()).alias("has_text"))


@query("extract_formats", "SELECT * FROM (VALUES ('a.csv', 'x y'), ('a.eml', 'From: a@b.co|Subject: hi|hello'), ('a.txt', 'plain'), ('a.rtf', 'bold text'), ('a.pdf', '')) t(name, text)")
def extract_formats(spark, sf_dir):
    cases = (("a.csv", b"x,y"), ("a.eml", b"From: a@b.co\nSubject: hi\n\nhello"), ("a.txt", b"plain"), ("a.rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}\b bold\b0  text\par}"), ("a.pdf", b"%PDF"))
    return spark.createDataFrame([(n, "|".join(x for x in extract_text(n, c)[0].split("\n") if x)) for n, c in cases], "name string, text string")
