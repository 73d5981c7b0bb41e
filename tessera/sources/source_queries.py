"""Queries through the file trees, the sinks, the change feeds and the lake's versions."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.plans.base import SQL, access_events, files, scan_results
from tessera.plans.dashboard import remediation
from tessera.plans.rows import cef
from tessera.session import shared_place, table
from tessera.sources import changes, sinks
from tessera.sources import files as tree
from tessera.sources.lake import COMPACT_AT, TABLES, Lake
from tessera.sources.lake_queries import results


def documents_as_files(spark: SparkSession, sf_dir: str) -> str:
    """Every document as a file source/lang/id.txt (every third as .log) below a new folder."""
    root = shared_place(spark, "tree")
    end = F.when(F.col("doc_id") % 3 == 0, ".log").otherwise(".txt")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), end))
    tree.put_files(table(spark, sf_dir, "documents").select(path.alias("path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content")), root)
    return root


_PATH = "source || '/' || lang || '/' || doc_id || case when doc_id % 3 = 0 then '.log' else '.txt' end"


def _below(column: str, root: str):
    return F.substring(column, len(tree.local(root)) + 2, 1 << 20)


@query("files_listing", f"SELECT {_PATH} AS path, strlen(coalesce(text, ''))::bigint AS file_size, case when doc_id % 3 = 0 then 'log' else 'txt' end AS extension, source || '/' || lang AS folder FROM documents")
def files_listing(spark, sf_dir):
    root = documents_as_files(spark, sf_dir)
    return tree.list_tree(spark, root).select(_below("file_path", root).alias("path"), "file_size", "extension", _below("folder", root).alias("folder"))


@query("files_pushed_filters", f"SELECT {_PATH} AS path, strlen(text)::bigint AS file_size FROM documents WHERE source LIKE 'src1%' AND doc_id % 3 = 0 AND strlen(text) BETWEEN 500 AND 5000")
def files_pushed_filters(spark, sf_dir):
    """Prefix, extension and size are the source's own work: other folders are never opened."""
    root = documents_as_files(spark, sf_dir)
    f = tree.list_tree(spark, root).where(F.col("file_path").startswith(f"{tree.local(root)}/src1") & (F.col("extension") == "log") & F.col("file_size").between(500, 5000))
    return f.select(_below("file_path", root).alias("path"), "file_size")


@query("files_folders", """SELECT source || '/' || lang AS folder, 2::int AS depth, count(*) AS n_files, sum(strlen(coalesce(text, '')))::bigint AS n_bytes FROM documents GROUP BY source, lang
  UNION ALL SELECT DISTINCT source, 1, 0::bigint, 0::bigint FROM documents UNION ALL SELECT '', 0, 0, 0""")
def files_folders(spark, sf_dir):
    root = documents_as_files(spark, sf_dir)
    return tree.list_folders(spark, root).select(_below("folder", root).alias("folder"), "depth", "n_files", "n_bytes")


@query("files_contents", f"SELECT {_PATH} AS path, sha256(coalesce(text, '')) AS content_hash FROM documents")
def files_contents(spark, sf_dir):
    root = documents_as_files(spark, sf_dir)
    return tree.list_tree(spark, root, contents=True).select(_below("file_path", root).alias("path"), F.sha2("content", 256).alias("content_hash"))


@query("sink_delivery", SQL + "SELECT file_path, case when scan_date <= date '2024-01-10' then 'first' when scan_date <= date '2024-01-20' then 'second' else 'third' end AS batch FROM scan")
def sink_delivery(spark, sf_dir):
    """Three runs of an export, each beyond the sink's cursor and one of them twice: every line once, in its batch."""
    at = shared_place(spark, "sink")
    r = scan_results(spark, sf_dir)
    lines = r.select(cef(r).alias("line"), F.date_format("scan_date", "yyyy-MM-dd").alias("cursor"))
    for day, batch in (("2024-01-10", "first"), ("2024-01-20", "second"), ("2024-01-20", "second"), ("2024-12-31", "third")):
        sinks.send_since(lines.where(F.col("cursor") <= day), at, "siem", batch)
    return sinks.sent(spark, at, "siem").select(F.regexp_extract("line", "fname=(\\S*)", 1).alias("file_path"), F.substring("batch", 7, 20).alias("batch"))


@query("sink_of_a_stream", SQL + "SELECT event_id FROM access WHERE action IS NOT NULL")
def sink_of_a_stream(spark, sf_dir):
    """Events exported by a stream that stops half way: the sink's manifests name every line once."""
    at = shared_place(spark, "stream-sink")
    os.makedirs(tree.local(at), exist_ok=True)
    spark.dataSource.register(sinks.Sink)
    e = access_events(spark, sf_dir).where("action is not null").select("event_id", "event_time")
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{at}/in")
        s = spark.readStream.schema("event_id long, event_time timestamp").parquet(f"{at}/in")
        lines = s.select(F.col("event_id").cast("string").alias("line"), F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("cursor"))
        lines.writeStream.format("tessera_sink").option("path", at).option("sink", "events").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    return sinks.sent(spark, at, "events").select(F.col("line").cast("long").alias("event_id"))


@query("change_feed", "SELECT '/' || source || '/' || doc_id || '.txt' AS file_path, timestamp '2024-01-01 00:00:00' + interval 1 minute * (doc_id % 1000) AS event_time, 'user' || doc_id % 17 AS user_name FROM documents WHERE doc_id % 10 NOT IN (3, 7)")
def change_feed(spark, sf_dir):
    """Documents as pages of a delta feed, some of them folders or deleted, read by a stream in two runs: each change once."""
    at = shared_place(spark, "feed")
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    text = lambda c: F.col(c).cast("string")
    item = F.struct(
        text("doc_id").alias("id"), F.concat(text("doc_id"), F.lit(".txt")).alias("name"), F.when(F.col("doc_id") % 10 == 3, "{}").alias("folder"), F.when(F.col("doc_id") % 10 == 7, "{}").alias("deleted"),
        F.struct(F.concat(F.lit("/drive/root:/"), "source").alias("path")).alias("parentReference"),
        F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("doc_id") % 1000).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastModifiedDateTime"),
        F.struct(F.struct(F.concat(F.lit("user"), (F.col("doc_id") % 17).cast("string")).alias("displayName")).alias("user")).alias("lastModifiedBy"),
    )
    # pages of a hundred changes
    pages = d.groupBy(F.expr("doc_id div 100").alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("value"), F.first("doc_id").cast("string").alias("token"))).alias("body"))
    pages = pages.select("page", F.format_string("%012d.json", "page").alias("path"), F.encode("body", "utf-8").alias("content"))
    os.makedirs(tree.local(f"{at}/pages"), exist_ok=True)
    for half in (pages.where("page < 5"), pages.where("page >= 5")):
        tree.put_files(half, f"{at}/pages")
        events = changes.file_events(changes.feed(spark, f"{at}/pages", maxPages=50))
        q = events.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").start()
        q.processAllAvailable()
        q.stop()
    return spark.read.parquet(f"{at}/out").select("file_path", "event_time", "user_name")


# --- the lake's versions -----------------------------------------------------------------------------
@query("lake_delete_by_job", SQL + "SELECT file_path, (doc_id % 5)::int AS job FROM scan WHERE doc_id % 5 <> 2")
def lake_delete_by_job(spark, sf_dir):
    """One of five jobs' results are deleted: the files that hold them are written anew, the others stay as they are."""
    lake = Lake(spark, shared_place(spark, "delete"))
    r = results(spark, sf_dir).withColumn("job", F.regexp_extract("file_name", "[0-9]+", 0).cast("long") % 5)
    job = lambda c: F.md5(F.concat(F.lit("job"), c.cast("string")))
    lake.append(r.withColumn("job_id", job(F.col("job"))), "scan_results")
    lake.delete_where("scan_results", F.lower(F.hex("job_id")) == job(F.lit(2)))
    jobs = F.create_map(*[x for i in range(5) for x in (job(F.lit(i)), F.lit(i))])
    return lake.read("scan_results").select("file_path", jobs[F.lower(F.hex("job_id"))].alias("job"))


@query("lake_time_travel", SQL + "SELECT version, count(*) AS n FROM scan, (VALUES (1), (2), (3)) v(version) WHERE version > 1 OR tenant = 'en' GROUP BY 1")
def lake_time_travel(spark, sf_dir):
    """An append, a second one and a compaction: each version stays readable as it was."""
    lake = Lake(spark, shared_place(spark, "versions"))
    r = results(spark, sf_dir)
    lake.append(r.where("tenant = 'en'"), "scan_results")
    lake.append(r.where("tenant <> 'en'"), "scan_results")
    lake.compact("scan_results", threshold=1)
    counts = [lake.read("scan_results", v).agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), "n") for v in (1, 2, 3)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def derived(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All seven tables of the lake, from the given tables."""
    f, text = files(spark, sf_dir), lambda c: F.md5(F.col(c).cast("string"))
    inventory = f.select(
        text("file_path").alias("id"), F.md5("source").alias("folder_id"), "file_path", "file_name", F.lit("filesystem").alias("adapter"), "file_size", "risk_score", "risk_tier", "entity_counts", "total_entities", "exposure_level", "owner",
        (F.col("total_entities") > 0).alias("is_monitored"), F.col("scan_date").cast("timestamp").alias("last_scanned_at"), "tenant", F.col("source").alias("target"))
    folders = f.groupBy("tenant", F.col("source").alias("target")).agg(
        F.count("*").cast("int").alias("file_count"), F.sum("file_size").alias("total_size_bytes"), F.bool_or(F.col("total_entities") > 0).alias("has_sensitive_files"), F.sum("total_entities").cast("int").alias("total_entities_found"))
    folders = folders.withColumn("folder_path", F.concat(F.lit("/"), "target", F.lit("/"), "tenant")).withColumn("id", text("folder_path"))
    below = folders.select("id", F.md5(F.concat(F.lit("/"), "target")).alias("parent_id"), F.col("folder_path").alias("dir_path"), F.col("tenant").alias("dir_name"), F.col("file_count").alias("child_file_count"), "tenant", "target")
    above = below.select(F.col("parent_id").alias("id"), F.concat(F.lit("/"), "target").alias("dir_path"), F.col("target").alias("dir_name"), "tenant", "target")
    a = access_events(spark, sf_dir)
    access = a.select(F.md5(F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), "action", "success", "user_name", "event_time", F.lit("t").alias("tenant"), F.to_date("event_time").alias("event_date"))
    audit = a.where("not success").select(F.md5(F.col("event_id").cast("string")).alias("id"), F.md5("user_name").alias("user_id"), "action", F.lit("file").alias("resource_type"), F.col("event_time").alias("created_at"), F.lit("t").alias("tenant"), F.to_date("event_time").alias("log_date"))
    remedies = remediation(spark, sf_dir).select(F.md5(F.col("id").cast("string")).alias("id"), "action_type", "status", "dry_run", F.lit("t").alias("tenant"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("action_date"))
    return {
        "scan_results": results(spark, sf_dir), "file_inventory": inventory, "folder_inventory": folders, "access_events": access, "audit_log": audit,
        "directory_tree": below.unionByName(above, allowMissingColumns=True), "remediation_actions": remedies,
    }


@query("lake_rebuild_all", SQL + """SELECT 'scan_results' AS name, count(*) AS n, count(DISTINCT (tenant, source, scan_date)) AS parts FROM scan UNION ALL SELECT 'file_inventory', count(*), count(DISTINCT (tenant, source)) FROM files
  UNION ALL SELECT 'folder_inventory', count(DISTINCT (tenant, source)), count(DISTINCT (tenant, source)) FROM files UNION ALL SELECT 'directory_tree', 2 * count(DISTINCT (tenant, source)), count(DISTINCT (tenant, source)) FROM files
  UNION ALL SELECT 'access_events', count(*), count(DISTINCT event_time::date) FROM access UNION ALL SELECT 'audit_log', count(*), count(DISTINCT event_time::date) FROM access WHERE NOT success
  UNION ALL SELECT 'remediation_actions', count(*), count(DISTINCT event_id % 30) FROM events""")
def lake_rebuild_all(spark, sf_dir):
    """All seven tables exported anew and read back through the catalog's views."""
    lake = Lake(spark, shared_place(spark, "rebuild-all"))
    lake.rebuild(derived(spark, sf_dir))
    counts = [lake.read(t).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*TABLES[t].partitions)).alias("parts")).select(F.lit(t).alias("name"), "n", "parts") for t in TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("lake_periodic_flush", SQL + f"SELECT count(*) AS n, count(DISTINCT event_id) AS events, 0::bigint AS again, (SELECT count(DISTINCT event_id % {COMPACT_AT}) FROM access) AS batches FROM access")
def lake_periodic_flush(spark, sf_dir):
    """A stream flushes events in batches into the lake; a batch that is given again adds nothing."""
    at = shared_place(spark, "periodic")
    lake = Lake(spark, f"{at}/lake")
    e = access_events(spark, sf_dir).select(F.col("event_id").cast("string").alias("file_path"), "action", "success", "user_name", "event_time", F.lit("t").alias("tenant"), F.to_date("event_time").alias("event_date"), (F.col("event_id") % COMPACT_AT).alias("part"))
    e.repartition(COMPACT_AT, "part").write.partitionBy("part").parquet(f"{at}/in")
    seen = []

    def each(df: DataFrame, batch: int) -> None:
        lake.append_once(df, "access_events", "flush", batch)
        seen.append(lake.append_once(df, "access_events", "flush", batch))  # as after a crash before the checkpoint

    for part in sorted(r.part for r in e.select("part").distinct().collect()):
        s = spark.readStream.schema(e.drop("part").schema).parquet(f"{at}/in/part={part}")
        s.writeStream.foreachBatch(lambda df, b, p=part: each(df, int(p) * 1000 + b)).option("checkpointLocation", f"{at}/cp{part}").trigger(availableNow=True).start().awaitTermination()
    out = lake.read("access_events").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("events"))
    return out.withColumn("again", F.lit(sum(seen)).cast("long")).withColumn("batches", F.lit(len(seen)).cast("long"))
