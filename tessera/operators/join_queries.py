"""Queries over as-of and interval joins, identities, dictionaries, sketches, fan-out and table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import dictionary as W
from tessera.operators import fanout, identities, ordered, table_functions
from tessera.plans import sketches
from tessera.plans.adhoc import run_guarded
from tessera.plans.base import EMAIL, PHONE, SQL, access_events, files, kept, scan_results
from tessera.session import shared_place, spread, table


# --- as-of and intervals -----------------------------------------------------------------------------
@query("asof_last_read", SQL + "SELECT event_id, (SELECT max((r.event_time, r.event_id)) FROM access r WHERE r.user_name = w.user_name AND r.action = 'read' AND r.event_time < w.event_time)[2] AS last_read FROM access w WHERE w.action = 'write'")
def asof_last_read(spark, sf_dir):
    """Each write with its user's last read before it; writes without one stay."""
    a = access_events(spark, sf_dir)
    reads = a.where("action = 'read'").select("user_name", "event_time", "event_id")
    joined = ordered.asof_join(a.where("action = 'write'").select("user_name", "event_time", "event_id"), reads, "user_name", "event_time", tie=("event_id",))
    return joined.select("event_id", F.col("right.event_id").alias("last_read"))


@query("asof_one_key", SQL + "SELECT event_id, (max(case when action = 'read' then (event_time, event_id) end) OVER (ORDER BY event_time RANGE UNBOUNDED PRECEDING))[2] AS last_read FROM access")
def asof_one_key(spark, sf_dir):
    """One key holds all events: the work is spread by time all the same."""
    a = access_events(spark, sf_dir).withColumn("all", F.lit("all"))
    joined = ordered.asof_join(a.select("all", "event_time", "event_id"), a.where("action = 'read'").select("all", "event_time", "event_id"), "all", "event_time", tie=("event_id",), strict=False)
    return joined.select("event_id", F.col("right.event_id").alias("last_read"))


@query("interval_overlap_join", """WITH a AS (SELECT p_partkey, p_retailprice::double AS s, p_retailprice::double + p_size * (1 + p_partkey % 5) AS e FROM part), b AS (SELECT c_custkey, c_acctbal::double AS s, c_acctbal::double + c_custkey % 300 AS e FROM customer)
SELECT p_partkey, count(*) AS n, sum(c_custkey)::bigint AS keys FROM a JOIN b ON a.s < b.e AND b.s < a.e AND b.s < b.e GROUP BY 1""")
def interval_overlap_join(spark, sf_dir):
    """Ranges of prices that meet ranges of balances: running sums over their edges, no pairs are made."""
    a = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("s"), (F.col("p_retailprice").cast("double") + F.col("p_size") * (1 + F.col("p_partkey") % 5)).alias("e"))
    b = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("s"), (F.col("c_acctbal").cast("double") + F.col("c_custkey") % 300).alias("e"))
    return ordered.overlap_sums(a, b, ("s", "e"), ("s", "e"), ("p_partkey",), "c_custkey").withColumnRenamed("total", "keys")


# --- identities --------------------------------------------------------------------------------------
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, mention: addresses (lower case) and phone numbers (digits) of every document."""
    def scan() -> DataFrame:
        d = spread(table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").contains("@") | F.col("text").contains("+")))
        every = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
        mail = F.transform(every(EMAIL), lambda v: F.concat(F.lit("EMAIL:"), F.lower(v)))
        phone = F.transform(every(PHONE), lambda v: F.concat(F.lit("PHONE:"), F.regexp_replace(v, "[^0-9]", "")))
        return d.select("doc_id", F.explode(F.array_distinct(F.concat(mail, phone))).alias("mention"))

    return kept(spark, sf_dir, "mentions", ("documents",), scan)


@query("identities_across_documents", rf"""WITH RECURSIVE m AS (SELECT DISTINCT doc_id, unnest(list_concat(list_transform(regexp_extract_all(text, '{EMAIL}'), lambda v: 'EMAIL:' || lower(v)), list_transform(regexp_extract_all(text, '{PHONE}'), lambda v: 'PHONE:' || regexp_replace(v, '[^0-9]', '', 'g')))) AS mention FROM documents),
deg AS (SELECT mention, count(*) AS n FROM m GROUP BY 1), big AS (SELECT doc_id, count(*) AS n FROM m GROUP BY 1),
e AS (SELECT m.* FROM m JOIN deg USING (mention) JOIN big USING (doc_id) WHERE deg.n <= {identities.HUB} AND big.n <= {identities.LIST}),
r AS (SELECT mention AS a, mention AS b FROM deg UNION SELECT r.a, y.mention FROM r JOIN e x ON x.mention = r.b JOIN e y ON y.doc_id = x.doc_id),
c AS (SELECT a AS mention, min(b) AS entity FROM r GROUP BY 1)
SELECT mention, deg.n AS n_docs, entity, first_value(mention) OVER (PARTITION BY entity ORDER BY deg.n DESC, mention) AS canonical, count(*) OVER (PARTITION BY entity) AS n_mentions FROM c JOIN deg USING (mention)""")
def identities_across_documents(spark, sf_dir):
    return identities.resolved(mentions(spark, sf_dir))


# --- dictionaries ------------------------------------------------------------------------------------
def benchmark_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary as large as its source: all runs of two to four words of the benchmark's items, as a Parquet table."""
    path = shared_place(spark, "dictionary")
    w = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).alias("category"), W.words(F.col("text")).alias("w"))
    runs = F.flatten(F.transform("w", lambda x, i: F.transform(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda n: F.when(i + n <= F.size("w"), F.array_join(F.slice(F.col("w"), i + 1, n), " ")))))
    terms = w.select("category", F.explode(runs).alias("term")).where("term is not null")
    W.build(terms, path)
    return W.load(spark, path)


_DICTIONARY = """WITH b AS (SELECT item_id % 5 AS category, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), n AS (SELECT unnest([2, 3, 4]) AS n),
t AS (SELECT term, min(category::varchar) AS category, n FROM (SELECT category, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS term FROM b, n WHERE len(w) >= n) GROUP BY term, n),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), p AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n),
f AS (SELECT doc_id, i, t.term, t.category, row_number() OVER (PARTITION BY doc_id, i ORDER BY p.n DESC) AS r FROM p JOIN t ON t.n = p.n AND t.term = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')) """


@query("dictionary_phrases", _DICTIONARY + "SELECT doc_id, category, count(*) AS n, count(DISTINCT term) AS n_terms FROM f WHERE r = 1 GROUP BY 1, 2")
def dictionary_phrases(spark, sf_dir):
    """How often each document holds terms of each category: the longest term at each position."""
    found = W.matches(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), benchmark_phrases(spark, sf_dir))
    return W.indicators(found)


# --- sketches ----------------------------------------------------------------------------------------
def stored_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state for each day and action of the events, as a Parquet table."""
    a = access_events(spark, sf_dir).select(F.to_date("event_time").alias("day"), "action", "user_name", F.floor(F.col("value") * 100).alias("value"))
    path = shared_place(spark, "rollup")
    sketches.rollup(a, ("day", "action"), "user_name", "value").write.partitionBy("day").parquet(path)
    return spark.read.parquet(path)


@query("sketch_rollup", SQL + "SELECT action, count(*) AS n, true AS users_close, true AS median_close, true AS p90_close FROM access WHERE action IS NOT NULL GROUP BY 1")
def sketch_rollup(spark, sf_dir):
    """Users and quantiles of each action over all days, from stored states; held against the exact ones within the stated errors."""
    got = sketches.merged(stored_rollup(spark, sf_dir).where("action is not null"), ("action",))
    a = access_events(spark, sf_dir).where("action is not null").select("action", "user_name", F.floor(F.col("value") * 100).alias("v"))
    e = sketches.RANK_ERROR
    edges = F.percentile("v", F.array(*map(F.lit, (0.5 - e, 0.5 + e, 0.9 - e, 0.9 + e))))
    exact = a.groupBy("action").agg(F.count_distinct("user_name").alias("users"), edges.alias("x"))
    j = got.join(exact, "action")
    return j.select("action", "n", (F.abs(F.col("distinct") - F.col("users")) <= sketches.COUNT_ERROR * F.col("users") + 1).alias("users_close"), F.col("q50").between(F.floor(F.col("x")[0]), F.ceil(F.col("x")[1])).alias("median_close"), F.col("q90").between(F.floor(F.col("x")[2]), F.ceil(F.col("x")[3])).alias("p90_close"))


@query("sketch_selection", SQL + "SELECT count(*) AS n, true AS users_close FROM access WHERE event_time >= timestamp '2024-01-10' AND event_time < timestamp '2024-01-20' AND action IS NOT NULL")
def sketch_selection(spark, sf_dir):
    """Ten days: only their partitions of the rollup are read."""
    got = sketches.merged(stored_rollup(spark, sf_dir).where("day >= date '2024-01-10' and day < date '2024-01-20' and action is not null"))
    a = access_events(spark, sf_dir).where("event_time >= timestamp '2024-01-10' and event_time < timestamp '2024-01-20' and action is not null")
    exact = a.agg(F.count_distinct("user_name").alias("users"))
    return got.crossJoin(F.broadcast(exact)).select("n", (F.abs(F.col("distinct") - F.col("users")) <= sketches.COUNT_ERROR * F.col("users") + 1).alias("users_close"))  # one row each


# --- fan-out -----------------------------------------------------------------------------------------
def skewed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a tree most of which lies in one folder."""
    l = table(spark, sf_dir, "lineitem")
    top = F.when(F.col("l_orderkey") % 10 < 8, "big").otherwise(F.concat(F.lit("s"), (F.col("l_orderkey") % 7).cast("string")))
    return l.select(F.concat_ws("/", F.lit(""), top, F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string")).alias("path"))


@query("fan_out_even", "SELECT case when count(*) < 10000 then 1 else least(16, greatest(2, count(*) // 1000)) end AS parts, count(*) AS n, true AS even FROM lineitem")
def fan_out_even(spark, sf_dir):
    """Ranges by sampled quantiles: none holds more than twice its share, though one folder holds most."""
    p = fanout.fan_out(skewed_paths(spark, sf_dir), "path").groupBy("part").agg(F.count("*").alias("n"))
    return p.agg(F.count("*").alias("parts"), F.sum("n").alias("n"), (F.max("n") <= 2 * F.sum("n") / F.count("*")).alias("even"))


@query("fan_out_ranges", "SELECT count(*) AS n, true AS apart FROM lineitem")
def fan_out_ranges(spark, sf_dir):
    """The ranges take every path once and do not overlap."""
    p = fanout.fan_out(skewed_paths(spark, sf_dir), "path").groupBy("part").agg(F.count("*").alias("n"), F.min("path").alias("lo"), F.max("path").alias("hi"))
    line = F.array_sort(F.collect_list(F.struct("part", "lo", "hi")))  # at most 16 ranges
    apart = F.expr("forall(sequence(0, size(r) - 2), i -> size(r) < 2 or r[i].hi < r[i + 1].lo)")
    return p.agg(F.sum("n").alias("n"), line.alias("r")).select("n", F.when(F.size("r") < 2, True).otherwise(apart).alias("apart"))


# --- table functions ---------------------------------------------------------------------------------
@query("table_function_chunks", "SELECT doc_id, n_chars::int AS last_end, case when n_chars <= 4000 then 1 else 2 end AS least FROM documents WHERE n_chars > 0")
def table_function_chunks(spark, sf_dir):
    """The chunker by name, in SQL that has passed the guard."""
    table_functions.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return run_guarded(
        spark, "SELECT doc_id, max(end) AS last_end, cast(least(count(*), 2) AS int) AS least FROM tessera_chunks(TABLE(SELECT doc_id, text FROM documents) PARTITION BY doc_id) GROUP BY doc_id", limit=None)


@query("table_function_spans", rf"SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}'))::bigint AS n FROM documents WHERE contains(text, '@') AND len(regexp_extract_all(text, '{EMAIL}')) > 0")
def table_function_spans(spark, sf_dir):
    """Detection by name: addresses of the documents that may have some."""
    table_functions.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return run_guarded(
        spark, "SELECT doc_id, count(*) AS n FROM tessera_spans(TABLE(SELECT doc_id, text FROM documents WHERE contains(text, '@')) PARTITION BY doc_id) WHERE entity_type = 'EMAIL' GROUP BY doc_id", limit=None)
