"""Joins, upserts and inventory maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalogue import query
from tessera.plans.base import SQL, access_events, files, scan_results
from tessera.plans.dashboard import n_if
from tessera.session import shared_place, table

# --- directory tree, security descriptors and folder inventory, derived from the parts and suppliers ---
TREE = """dirs AS (SELECT p_partkey AS id, p_partkey * 7 AS dir_ref, case when p_partkey < 10 then NULL else (p_partkey // 10) * 7 end AS parent_ref, '/' || p_brand || '/' || p_partkey AS dir_path, case when p_partkey % 13 = 0 then NULL else p_size % 9 end AS sd_id FROM part),
 sds AS (SELECT s AS sd_id, case s % 5 when 0 then 'PUBLIC' when 1 then 'ORG_WIDE' when 2 then 'INTERNAL' else 'PRIVATE' end AS exposure, 'owner' || s AS owner FROM range(7) t(s))"""


def dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7).alias("dir_ref"), F.when(F.col("p_partkey") >= 10, F.expr("(p_partkey div 10) * 7")).alias("parent_ref"),
        F.concat(F.lit("/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("dir_path"), F.when(F.col("p_partkey") % 13 != 0, (F.col("p_size") % 9).cast("long")).alias("sd_id"))


def descriptors(spark: SparkSession) -> DataFrame:
    s = spark.range(7).withColumnRenamed("id", "sd_id")
    level = F.element_at(F.array(*map(F.lit, ("PUBLIC", "ORG_WIDE", "INTERNAL", "PRIVATE", "PRIVATE"))), (F.col("sd_id") % 5 + 1).cast("int"))
    return s.select("sd_id", level.alias("exposure"), F.concat(F.lit("owner"), F.col("sd_id").cast("string")).alias("owner"))


@query("browse_directories", "WITH " + TREE + """, folders AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT d.id, d.dir_path, s.exposure, s.owner, f.n AS files FROM dirs d LEFT JOIN sds s ON s.sd_id = d.sd_id LEFT JOIN folders f ON f.p_brand = string_split(d.dir_path, '/')[2] WHERE d.parent_ref = 70""")
def browse_directories(spark, sf_dir):
    """Children of a directory with their descriptor and folder figures: two left joins."""
    folders = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("files"))
    d = dirs(spark, sf_dir).where("parent_ref = 70").withColumn("p_brand", F.split("dir_path", "/")[1])
    return d.join(descriptors(spark), "sd_id", "left").join(folders, "p_brand", "left").select("id", "dir_path", "exposure", "owner", "files")


@query("exposure_summary", "WITH " + TREE + " SELECT coalesce(exposure, 'UNKNOWN') AS exposure, count(*) AS n FROM dirs LEFT JOIN sds USING (sd_id) GROUP BY 1")
def exposure_summary(spark, sf_dir):
    return dirs(spark, sf_dir).join(descriptors(spark), "sd_id", "left").groupBy(F.coalesce("exposure", F.lit("UNKNOWN")).alias("exposure")).agg(F.count("*").alias("n"))


@query("index_stats", "WITH " + TREE + " SELECT count(*) AS total_dirs, count(p.id) AS with_parent_link, count(c.sd_id) AS with_descriptor FROM dirs c LEFT JOIN dirs p ON c.parent_ref = p.dir_ref AND c.id <> p.id")
def index_stats(spark, sf_dir):
    """How far the tree is indexed: directories, those whose parent is known, those with a descriptor."""
    d = dirs(spark, sf_dir)
    parents = d.select(F.col("id").alias("parent_id"), F.col("dir_ref").alias("parent_ref"))
    linked = d.join(parents, (d["parent_ref"] == parents["parent_ref"]) & (d["id"] != parents["parent_id"]), "left")
    return linked.agg(F.count("*").alias("total_dirs"), F.count("parent_id").alias("with_parent_link"), F.count("sd_id").alias("with_descriptor"))


@query("descriptor_stats", "WITH " + TREE + " SELECT count(DISTINCT sd_id) AS unique_sds, count(DISTINCT sd_id) FILTER (exposure = 'PUBLIC') AS world_accessible, count(DISTINCT sd_id) FILTER (exposure = 'ORG_WIDE') AS authenticated_users, count(DISTINCT sd_id) FILTER (exposure = 'INTERNAL') AS custom_acl FROM dirs JOIN sds USING (sd_id)")
def descriptor_stats(spark, sf_dir):
    """Descriptors in use, by exposure. Those in use are made distinct first, so the counts need no second one."""
    used = dirs(spark, sf_dir).select("sd_id").distinct().join(descriptors(spark), "sd_id")
    return used.agg(F.count("*").alias("unique_sds"), *[n_if(F.col("exposure") == e).alias(n) for e, n in (("PUBLIC", "world_accessible"), ("ORG_WIDE", "authenticated_users"), ("INTERNAL", "custom_acl"))])


@query("exposure_unknown_anti", "WITH " + TREE + " SELECT id, dir_path FROM dirs WHERE sd_id IS NULL OR sd_id NOT IN (SELECT sd_id FROM sds)")
def exposure_unknown_anti(spark, sf_dir):
    return dirs(spark, sf_dir).join(descriptors(spark), "sd_id", "left_anti").select("id", "dir_path")


@query("exposure_filter", "WITH " + TREE + " SELECT id, dir_path, exposure FROM dirs JOIN sds USING (sd_id) WHERE exposure IN ('PUBLIC', 'ORG_WIDE')")
def exposure_filter(spark, sf_dir):
    return dirs(spark, sf_dir).join(descriptors(spark).where(F.col("exposure").isin("PUBLIC", "ORG_WIDE")), "sd_id").select("id", "dir_path", "exposure")


@query("principal_access", "WITH " + TREE + " SELECT id, dir_path, sd_id FROM dirs JOIN sds USING (sd_id) WHERE sd_id % 3 = 1")
def principal_access(spark, sf_dir, principal: str = "group1"):
    """Directories whose descriptor's permissions (JSON) name a principal."""
    perms = descriptors(spark).withColumn("permissions_json", F.concat(F.lit('{"group'), (F.col("sd_id") % 3).cast("string"), F.lit('":"read"}')))
    has = F.map_contains_key(F.from_json("permissions_json", "map<string,string>"), principal)
    return dirs(spark, sf_dir).join(perms.where(has), "sd_id").select("id", "dir_path", "sd_id")


@query("tree_parents", "WITH " + TREE + " SELECT c.id, p.id AS parent_id FROM dirs c JOIN dirs p ON c.parent_ref = p.dir_ref AND c.id <> p.id")
def tree_parents(spark, sf_dir):
    d = dirs(spark, sf_dir)
    p = d.select(F.col("id").alias("parent_id"), F.col("dir_ref").alias("parent_ref"))
    return d.join(p, "parent_ref").where("id <> parent_id").select("id", "parent_id")


@query("tree_parents_by_path", SQL + """, folders AS (SELECT DISTINCT '/' || source AS path FROM files UNION SELECT DISTINCT '/' || source || '/' || tenant FROM files) SELECT c.path, p.path AS parent FROM folders c JOIN folders p ON regexp_replace(c.path, '/[^/]*$', '') = p.path""")
def tree_parents_by_path(spark, sf_dir):
    """Parents by the path itself: the parent's path is a computed key of an equi-join."""
    f = files(spark, sf_dir).select("source", "tenant")
    paths = f.select(F.concat(F.lit("/"), "source").alias("path")).unionByName(f.select(F.concat(F.lit("/"), "source", F.lit("/"), "tenant").alias("path"))).distinct()
    c = paths.withColumn("parent", F.regexp_replace("path", "/[^/]*$", ""))
    return c.join(paths.select(F.col("path").alias("parent")), "parent").select("path", "parent")


@query("tree_depth_recursive", "WITH RECURSIVE " + TREE + ", walk AS (SELECT id, dir_ref, 0 AS depth FROM dirs WHERE parent_ref IS NULL UNION ALL SELECT d.id, d.dir_ref, w.depth + 1 FROM dirs d JOIN walk w ON d.parent_ref = w.dir_ref) SELECT depth, count(*) AS n FROM walk GROUP BY 1")
def tree_depth_recursive(spark, sf_dir):
    """Directories by depth: the walk over the adjacency list, level by level."""
    return depths(dirs(spark, sf_dir))


def depths(tree: DataFrame) -> DataFrame:
    """depth, n: how many walks from the roots end at each depth. Neither rows nor depth are limited, as they are in a recursive query.

    A level is stored as its directories with the number of walks that reach them; the next one is a join with it.
    """
    spark, at, depth = tree.sparkSession, shared_place(tree.sparkSession, "walk"), 0
    schema = T.StructType([T.StructField("dir_ref", tree.schema["dir_ref"].dataType), T.StructField("n", T.LongType())])
    level, children = tree.where("parent_ref IS NULL").groupBy("dir_ref").agg(F.count("*").alias("n")), tree.where("parent_ref IS NOT NULL").select("dir_ref", "parent_ref")
    while True:
        level.write.parquet(f"{at}/depth={depth}")
        level = spark.read.schema(schema).parquet(f"{at}/depth={depth}")
        if level.isEmpty():
            break
        above = level.select(F.col("dir_ref").alias("parent_ref"), "n")
        level, depth = children.join(above, "parent_ref").groupBy("dir_ref").agg(F.sum("n").alias("n")), depth + 1
    walks = spark.read.schema(schema.add("depth", T.IntegerType())).parquet(at)
    return walks.groupBy("depth").agg(F.sum("n").alias("n"))


@query("monitored_first_match", SQL + """, m AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY tenant, doc_id) AS rn FROM scan) SELECT a.event_id, m.file_path FROM access a JOIN m ON m.rn = 1 AND a.doc_id % 50 = m.doc_id % 50 WHERE a.action = 'write'""")
def monitored_first_match(spark, sf_dir):
    """Events joined to the first monitored file of their slot, by tenant."""
    # min_by is partial before its shuffle, so a slot of any size is one row a task
    first = scan_results(spark, sf_dir).groupBy((F.col("doc_id") % 50).alias("slot")).agg(F.min_by("file_path", F.struct("tenant", "doc_id")).alias("file_path"))
    return access_events(spark, sf_dir).where("action = 'write'").withColumn("slot", F.col("doc_id") % 50).join(first, "slot").select("event_id", "file_path")


# --- delta sync: a stored snapshot against the live files -------------------------------------------
DELTA = SQL + """, live AS (SELECT file_path, cast(doc_id as double) + case when doc_id % 7 = 2 then 5 when doc_id % 7 = 3 then 0.5 else 0 end AS mtime FROM files WHERE doc_id % 7 <> 0),
 stored AS (SELECT file_path, case when doc_id % 7 = 4 then NULL else cast(doc_id as double) end AS mtime, 'sd' || doc_id AS sd_hash FROM files WHERE doc_id % 7 <> 1)"""


def live_files(spark, sf_dir):
    m = F.col("doc_id").cast("double") + F.when(F.col("doc_id") % 7 == 2, 5.0).when(F.col("doc_id") % 7 == 3, 0.5).otherwise(0.0)
    return files(spark, sf_dir).where("doc_id % 7 <> 0").select("file_path", m.alias("mtime"))


def stored_files(spark, sf_dir):
    return files(spark, sf_dir).where("doc_id % 7 <> 1").select("file_path", F.when(F.col("doc_id") % 7 != 4, F.col("doc_id").cast("double")).alias("mtime"), F.concat(F.lit("sd"), F.col("doc_id").cast("string")).alias("sd_hash"))


def delta(live: DataFrame, stored: DataFrame, key: str = "file_path") -> DataFrame:
    """One row per path of either side with its action; an updated row loses its descriptor hash."""
    both = live.alias("l").join(stored.alias("s"), F.col(f"l.{key}") == F.col(f"s.{key}"), "full_outer")
    new, gone = F.col(f"s.{key}").isNull(), F.col(f"l.{key}").isNull()
    changed = F.col("s.mtime").isNull() | F.col("l.mtime").isNull() | (F.abs(F.col("l.mtime") - F.col("s.mtime")) >= 1.0)
    action = F.when(new, "insert").when(gone, "delete").when(changed, "update").otherwise("unchanged")
    return both.select(F.coalesce(f"l.{key}", f"s.{key}").alias(key), action.alias("action"), F.coalesce("l.mtime", "s.mtime").alias("mtime"), F.when(action == "unchanged", F.col("s.sd_hash")).alias("sd_hash"))


@query("delta_sync", DELTA + """ SELECT coalesce(l.file_path, s.file_path) AS file_path, case when s.file_path IS NULL then 'insert' when l.file_path IS NULL then 'delete' when s.mtime IS NULL OR abs(l.mtime - s.mtime) >= 1.0 then 'update' else 'unchanged' end AS action, coalesce(l.mtime, s.mtime) AS mtime,
  case when s.file_path IS NOT NULL AND l.file_path IS NOT NULL AND s.mtime IS NOT NULL AND abs(l.mtime - s.mtime) < 1.0 then s.sd_hash end AS sd_hash FROM live l FULL JOIN stored s ON l.file_path = s.file_path""")
def delta_sync(spark, sf_dir):
    return delta(live_files(spark, sf_dir), stored_files(spark, sf_dir))


@query("deleted_paths_except", DELTA + " SELECT file_path FROM stored EXCEPT SELECT file_path FROM live")
def deleted_paths_except(spark, sf_dir):
    return stored_files(spark, sf_dir).select("file_path").exceptAll(live_files(spark, sf_dir).select("file_path"))


@query("sd_dedup", """WITH acl AS (SELECT p_partkey AS id, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS acl FROM part) SELECT sha256(acl) AS sd_hash, min(id) AS first_id, count(*) AS n FROM acl GROUP BY 1""")
def sd_dedup(spark, sf_dir):
    """Content-addressed descriptors: the hash of their canonical JSON is their key."""
    acl = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("acl"))
    return acl.groupBy(F.sha2("acl", 256).alias("sd_hash")).agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


@query("sd_upsert_do_nothing", """WITH acl AS (SELECT DISTINCT sha256('{"brand":"' || p_brand || '","size":' || p_size || '}') AS h FROM part), old AS (SELECT h FROM acl WHERE h < '8') SELECT h AS sd_hash, 'new' AS origin FROM acl WHERE h NOT IN (SELECT h FROM old) UNION ALL SELECT h, 'old' FROM old""")
def sd_upsert_do_nothing(spark, sf_dir):
    new = sd_dedup(spark, sf_dir).select("sd_hash")
    old = new.where("sd_hash < '8'")
    return new.join(old, "sd_hash", "left_anti").withColumn("origin", F.lit("new")).unionByName(old.withColumn("origin", F.lit("old")))


@query("mark_missing", DELTA + " SELECT s.file_path, l.file_path IS NULL AS needs_rescan FROM stored s LEFT JOIN live l USING (file_path)")
def mark_missing(spark, sf_dir):
    seen = live_files(spark, sf_dir).select("file_path", F.lit(True).alias("seen"))
    return stored_files(spark, sf_dir).select("file_path").join(seen, "file_path", "left").select("file_path", F.col("seen").isNull().alias("needs_rescan"))


INVENTORY = SQL + """, inv AS (SELECT file_path, 'h' || (doc_id // case when doc_id % 5 = 1 then 2 else 1 end) AS content_hash, scan_date AS modified, file_size + case when doc_id % 5 = 2 then 1 else 0 end AS file_size, doc_id % 9 = 0 AS needs_rescan, doc_id % 4 AS scan_count, doc_id % 3 AS changed_count FROM files WHERE doc_id % 6 <> 0),
 cur AS (SELECT file_path, case when doc_id % 8 = 0 then NULL else 'h' || doc_id end AS content_hash, scan_date + case when doc_id % 5 = 3 then 1 else 0 end AS modified, file_size FROM files)"""


def inventory(spark, sf_dir):
    h = F.when(F.col("doc_id") % 5 == 1, F.expr("doc_id div 2")).otherwise(F.col("doc_id"))
    return files(spark, sf_dir).where("doc_id % 6 <> 0").select(
        "file_path", F.concat(F.lit("h"), h.cast("string")).alias("content_hash"), F.col("scan_date").alias("modified"), (F.col("file_size") + F.when(F.col("doc_id") % 5 == 2, 1).otherwise(0)).alias("file_size"),
        (F.col("doc_id") % 9 == 0).alias("needs_rescan"), (F.col("doc_id") % 4).alias("scan_count"), (F.col("doc_id") % 3).alias("changed_count"))


def current(spark, sf_dir):
    return files(spark, sf_dir).select("file_path", F.when(F.col("doc_id") % 8 != 0, F.concat(F.lit("h"), F.col("doc_id").cast("string"))).alias("content_hash"), F.date_add("scan_date", F.when(F.col("doc_id") % 5 == 3, 1).otherwise(0)).alias("modified"), "file_size")


@query("should_scan", INVENTORY + """ SELECT c.file_path, case when i.file_path IS NULL then 'new_file' when i.needs_rescan then 'flagged_rescan' when c.content_hash IS NOT NULL AND c.content_hash <> i.content_hash then 'content_changed' when c.modified > i.modified then 'modified_time' when c.file_size <> i.file_size then 'size_changed' else 'unchanged' end AS reason FROM cur c LEFT JOIN inv i USING (file_path)""")
def should_scan(spark, sf_dir, full_scan: bool = False):
    """Why each file is scanned, or that it is unchanged; the first reason in order counts."""
    i = inventory(spark, sf_dir).select("file_path", F.lit(True).alias("known"), F.col("content_hash").alias("i_hash"), F.col("modified").alias("i_modified"), F.col("file_size").alias("i_size"), "needs_rescan")
    j = current(spark, sf_dir).join(i, "file_path", "left")
    reason = F.when(F.lit(full_scan), "full_scan").when(F.col("known").isNull(), "new_file").when(F.col("needs_rescan"), "flagged_rescan").when(F.col("content_hash") != F.col("i_hash"), "content_changed").when(F.col("modified") > F.col("i_modified"), "modified_time").when(F.col("file_size") != F.col("i_size"), "size_changed").otherwise("unchanged")
    return j.select("file_path", reason.alias("reason"))


@query("merge_inventory", INVENTORY + """ SELECT coalesce(c.file_path, i.file_path) AS file_path, coalesce(c.content_hash, i.content_hash) AS content_hash, coalesce(i.scan_count, 0) + 1 AS scan_count, coalesce(i.changed_count, 0) + case when c.content_hash IS NOT NULL AND i.content_hash IS NOT NULL AND c.content_hash <> i.content_hash then 1 else 0 end AS changed_count FROM cur c FULL JOIN inv i ON c.file_path = i.file_path""")
def merge_inventory(spark, sf_dir):
    c, i = current(spark, sf_dir).alias("c"), inventory(spark, sf_dir).alias("i")
    changed = F.when(F.col("c.content_hash") != F.col("i.content_hash"), 1).otherwise(0)
    return c.join(i, F.col("c.file_path") == F.col("i.file_path"), "full_outer").select(
        F.coalesce("c.file_path", "i.file_path").alias("file_path"), F.coalesce("c.content_hash", "i.content_hash").alias("content_hash"),
        (F.coalesce("i.scan_count", F.lit(0)) + 1).alias("scan_count"), (F.coalesce("i.changed_count", F.lit(0)) + changed).alias("changed_count"))


@query("label_sync", """WITH remote AS (SELECT n_nationkey AS id, n_name || case when n_nationkey % 4 = 0 then '!' else '' end AS name FROM nation WHERE n_nationkey % 5 <> 0), here AS (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 5 <> 1)
 SELECT coalesce(r.id, h.id) AS id, case when h.id IS NULL then 'insert' when r.id IS NULL then 'remove' when r.name <> h.name then 'update' else 'keep' end AS action FROM remote r FULL JOIN here h ON r.id = h.id""")
def label_sync(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    r = n.where("id % 5 <> 0").select("id", F.concat("name", F.when(F.col("id") % 4 == 0, "!").otherwise("")).alias("r_name"))
    h = n.where("id % 5 <> 1").withColumnRenamed("name", "h_name")
    action = F.when(F.col("h_name").isNull(), "insert").when(F.col("r_name").isNull(), "remove").when(F.col("r_name") != F.col("h_name"), "update").otherwise("keep")
    return r.join(h, "id", "full_outer").select("id", action.alias("action"))


# --- label rules: the first rule per value -----------------------------------------------------------
RULES = [("entity_type", "CREDIT_CARD", 5, "Restricted"), ("entity_type", "CREDIT_CARD", 9, "Cardholder"), ("entity_type", "EMAIL", 4, "Personal"), ("risk_tier", "CRITICAL", 3, "Secret"), ("risk_tier", "MEDIUM", 1, "Internal")]
RULES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', {c}, '{d}')" for a, b, c, d in RULES) + ") r(kind, value, priority, label)"


@query("label_rules", SQL + f""", r AS (SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY priority DESC, label) AS rn FROM {RULES_SQL}), byent AS (SELECT e.doc_id, max_by(r.label, r.priority * 1000 - ascii(e.entity_type)) AS label FROM ents e JOIN r ON r.kind = 'entity_type' AND r.rn = 1 AND r.value = e.entity_type GROUP BY 1)
 SELECT scan.file_path, coalesce(byent.label, t.label, 'General') AS label FROM scan LEFT JOIN byent USING (doc_id) LEFT JOIN r t ON t.kind = 'risk_tier' AND t.rn = 1 AND t.value = scan.risk_tier""")
def label_rules(spark, sf_dir, default: str = "General"):
    """Rules on entity types come first (by priority, then type), then rules on tiers, then the default."""
    from tessera.plans.base import entities

    rules = spark.createDataFrame(RULES, "kind string, value string, priority int, label string")
    first = rules.withColumn("rn", F.row_number().over(Window.partitionBy("kind", "value").orderBy(F.desc("priority"), "label"))).where("rn = 1")
    r = scan_results(spark, sf_dir)
    # the rule tables hold one row per value
    by_type = first.where("kind = 'entity_type'").select(F.col("value").alias("entity_type"), F.col("label").alias("type_label"), "priority")
    per = entities(r).join(by_type, "entity_type").groupBy("doc_id").agg(F.min_by("type_label", F.struct(-F.col("priority"), "entity_type")).alias("type_label"))
    by_tier = first.where("kind = 'risk_tier'").select(F.col("value").alias("risk_tier"), F.col("label").alias("tier_label"))
    return r.join(per, "doc_id", "left").join(by_tier, "risk_tier", "left").select("file_path", F.coalesce("type_label", "tier_label", F.lit(default)).alias("label"))


@query("folder_rollup", SQL + """SELECT source AS folder, count(*) AS file_count, sum(file_size)::bigint AS total_size, bool_or(total_entities > 0) AS has_sensitive, case max(case risk_tier when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end) when 4 then 'CRITICAL' when 3 then 'HIGH' when 2 then 'MEDIUM' when 1 then 'LOW' else 'MINIMAL' end AS highest_tier, sum(total_entities)::bigint AS entities FROM files GROUP BY 1""")
def folder_rollup(spark, sf_dir):
    from tessera import taxonomy as X

    top = F.max(X.tier_ordinal(F.col("risk_tier")))
    return files(spark, sf_dir).groupBy(F.col("source").alias("folder")).agg(
        F.count("*").alias("file_count"), F.sum("file_size").alias("total_size"), F.bool_or(F.col("total_entities") > 0).alias("has_sensitive"),
        F.element_at(F.array(*map(F.lit, X.TIER_ORDER)), top + 1).alias("highest_tier"), F.sum("total_entities").cast("long").alias("entities"))


@query("delete_results_by_job", SQL + "SELECT tenant, count(*) AS left_over FROM scan WHERE NOT (scan_date = date '2024-01-10' AND tenant = 'en') GROUP BY 1")
def delete_results_by_job(spark, sf_dir):
    """What stays when one job's partition is rewritten."""
    return scan_results(spark, sf_dir).where(~((F.col("scan_date") == F.lit("2024-01-10").cast("date")) & (F.col("tenant") == "en"))).groupBy("tenant").agg(F.count("*").alias("left_over"))
