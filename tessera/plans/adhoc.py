"""The ad-hoc SQL surface: a guard in front of spark.sql, tenant views, and the operators it reaches."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.plans.base import SQL, access_events, files, scan_results
from tessera.session import table

MAX_QUERY, MAX_ROWS, DEFAULT_ROWS, TIMEOUT = 10_000, 10_000, 1_000, 30.0
#: Words that no read needs, and functions and relations that leave the lake.
FORBIDDEN = "INSERT UPDATE DELETE DROP CREATE ALTER TRUNCATE GRANT REVOKE COPY ATTACH DETACH EXECUTE CALL PRAGMA LOAD INSTALL EXPORT IMPORT SET RESET ADD REFRESH CACHE UNCACHE ANALYZE MSCK TRANSFORM".split()
ESCAPES = "read_parquet read_csv read_csv_auto read_json read_text read_blob read_files glob parquet_scan httpfs sqlite_scan postgres_scan java_method reflect try_reflect".split()
_WORD = re.compile(r"(?<![A-Za-z0-9_.])(" + "|".join(FORBIDDEN) + r")(?![A-Za-z0-9_])", re.I)
_ESCAPE = re.compile(r"\b(" + "|".join(ESCAPES) + r")\s*\(", re.I)
_PATH = re.compile(r"\b(parquet|csv|json|orc|avro|text|binaryfile|delta|xml)\s*\.\s*`", re.I)


#: Whether a path may stand for a table. A query is analysed under a lock, for the setting is the session's.
_FILES = "spark.sql.runSQLOnFiles"
_ANALYSIS = threading.Lock()


class Rejected(ValueError):
    """A query the guard does not let through."""


def outside_quotes(sql: str):
    """(position, character) of what stands outside quotes and comments."""
    i, n = 0, len(sql)
    while i < n:
        c = sql[i]
        if c in "'\"`":
            i += 1
            while i < n:
                if sql[i] == "\\" and c != "`":
                    i += 2
                    continue
                if sql[i] == c:
                    if i + 1 < n and sql[i + 1] == c:
                        i += 2
                        continue
                    break
                i += 1
            i += 1
        elif sql.startswith("--", i):
            i = n if (j := sql.find("\n", i)) < 0 else j
        elif sql.startswith("/*", i):
            i = n if (j := sql.find("*/", i)) < 0 else j + 2
        else:
            yield i, c
            i += 1


def validate(sql: str) -> str:
    """The query without a closing semicolon, or Rejected. Forbidden words count even inside literals."""
    text = sql.strip()
    if not text:
        raise Rejected("empty query")
    if len(text) > MAX_QUERY:
        raise Rejected("query too long")
    text = text.rstrip().removesuffix(";").rstrip()
    if any(c == ";" for _, c in outside_quotes(text)):
        raise Rejected("one statement only")
    bare = "".join(c for _, c in outside_quotes(text)).lstrip(" (\n\t")
    if not re.match(r"(SELECT|WITH)\b", bare, re.I):
        raise Rejected("only SELECT or WITH")
    for pattern in (_WORD, _ESCAPE, _PATH):
        if m := pattern.search(text):
            raise Rejected(f"{m[1]} is not allowed")
    return text


def bind_tenant(sql: str) -> str:
    """$1 outside quotes becomes the named parameter :tenant."""
    spots = {i for i, c in outside_quotes(sql) if c == "$" and sql.startswith("$1", i) and not sql[i + 2 : i + 3].isdigit()}
    out, i = [], 0
    while i < len(sql):
        if i in spots:
            out.append(":tenant")
            i += 2
        else:
            out.append(sql[i])
            i += 1
    return "".join(out)


def tenant_views(spark: SparkSession, sf_dir: str, tenant: str | None) -> None:
    """Views that hold one tenant's rows only: isolation does not depend on the query."""
    r, a = scan_results(spark, sf_dir), access_events(spark, sf_dir)
    if tenant is not None:
        own = files(spark, sf_dir).where(F.col("tenant") == tenant).select("doc_id")
        r, a = r.where(r.tenant == tenant), a.join(own, "doc_id", "left_semi")  # an event belongs to its file's tenant
    r.createOrReplaceTempView("scan_results")
    a.createOrReplaceTempView("access_events")
    for t in ("lineitem", "orders", "customer", "nation", "part"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)


def run_guarded(spark: SparkSession, sql: str, tenant: str = "", limit: int | None = DEFAULT_ROWS) -> DataFrame:
    """The guarded query as a DataFrame of at most limit + 1 rows; the extra row tells that it was cut. None: uncut, for jobs that write what they find."""
    text = bind_tenant(validate(sql))
    with _ANALYSIS:
        # whatever the spelling (quotes, comments), no relation is a file: names are looked up among the views only
        before = spark.conf.get(_FILES, "true")
        spark.conf.set(_FILES, "false")
        try:
            df = spark.sql(text, args={"tenant": tenant} if ":tenant" in text else None)
        except AnalysisException as e:
            raise Rejected(str(e).splitlines()[0]) from e
        finally:
            spark.conf.set(_FILES, before)
    return df if limit is None else df.limit(min(limit, MAX_ROWS) + 1)


def fetch(spark: SparkSession, sql: str, tenant: str = "", limit: int = DEFAULT_ROWS, timeout: float = TIMEOUT) -> dict:
    """columns, rows and truncated; a query over its time is cancelled by its job tag."""
    df = run_guarded(spark, sql, tenant, limit)
    tag = f"adhoc-{uuid.uuid4().hex}"
    timer = threading.Timer(timeout, lambda: spark.interruptTag(tag))
    spark.addTag(tag)
    timer.start()
    try:
        rows = [r.asDict(recursive=True) for r in df.collect()]
    finally:
        timer.cancel()
        spark.removeTag(tag)
    most = min(limit, MAX_ROWS)
    return {"columns": df.columns, "rows": rows[:most], "truncated": len(rows) > most}


def fetch_arrow(spark: SparkSession, sql: str, tenant: str = "", limit: int = DEFAULT_ROWS):
    """The rows as an Arrow table, without Python objects, and whether it was cut."""
    got, most = run_guarded(spark, sql, tenant, limit).toArrow(), min(limit, MAX_ROWS)
    return got.slice(0, most), got.num_rows > most


def describe(spark: SparkSession, names: tuple[str, ...] = ("scan_results", "access_events")) -> dict[str, list[tuple[str, str]]]:
    """Columns and types of the views."""
    return {n: spark.table(n).dtypes for n in names}


#: name -> (Spark SQL, DuckDB SQL or None where the text is the same)
CASES: dict[str, tuple[str, str | None]] = {
    "adhoc_tenant_filter": ("SELECT file_path, risk_score FROM scan_results WHERE tenant = $1 AND risk_score > 30", SQL + "SELECT file_path, risk_score FROM scan WHERE tenant = 'en' AND risk_score > 30"),
    "adhoc_tenant_events": ("SELECT event_id, action FROM access_events WHERE $1 = 'en'", SQL + "SELECT event_id, action FROM access WHERE doc_id IN (SELECT doc_id FROM files WHERE tenant = 'en')"),
    "adhoc_grouping_sets": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", None),
    "adhoc_rollup": ("SELECT l_returnflag, l_shipdate_year, sum(l_quantity) AS q FROM (SELECT l_returnflag, cast(year(l_shipdate) AS bigint) AS l_shipdate_year, l_quantity FROM lineitem) t GROUP BY ROLLUP (l_returnflag, l_shipdate_year)", None),
    "adhoc_cube": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    "adhoc_full_join": ("SELECT c.c_custkey, o.o_orderkey FROM customer c FULL JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000", None),
    "adhoc_semi_join": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)", None),
    "adhoc_anti_join": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    "adhoc_correlated": ("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    "adhoc_window_rank": ("SELECT o_custkey, o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS bigint) AS rn, cast(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS bigint) AS rk FROM orders", None),
    "adhoc_window_frame": ("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders", None),
    "adhoc_qualify": ("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) t WHERE rn = 1", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1"),
    "adhoc_intersect_all": ("SELECT o_custkey % 50 AS k FROM orders INTERSECT ALL SELECT c_custkey % 60 AS k FROM customer", None),
    "adhoc_except_all": ("SELECT o_custkey % 50 AS k FROM orders EXCEPT ALL SELECT c_custkey % 60 AS k FROM customer", None),
    "adhoc_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT n_nationkey FROM nation", None),
    "adhoc_unnest": ("SELECT file_path, t.entity_type, t.n FROM scan_results LATERAL VIEW explode(entity_counts) t AS entity_type, n", SQL + "SELECT file_path, entity_type, n::int AS n FROM ents"),
    "adhoc_pivot": ("SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (sum(l_quantity) FOR l_linestatus IN ('F' AS f, 'O' AS o))", "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS f, sum(l_quantity) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1"),
    "adhoc_unpivot": ("SELECT p_partkey, k, v FROM (SELECT p_partkey, p_size, cast(p_retailprice AS int) AS price FROM part) UNPIVOT (v FOR k IN (p_size, price))", "SELECT p_partkey, 'p_size' AS k, p_size AS v FROM part UNION ALL SELECT p_partkey, 'price', trunc(p_retailprice)::int FROM part"),
    "adhoc_lateral": ("SELECT c.c_custkey, t.n FROM customer c, LATERAL (SELECT count(*) AS n FROM orders o WHERE o.o_custkey = c.c_custkey) t", None),
    "adhoc_recursive": ("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 50) SELECT cast(sum(n) AS bigint) AS s FROM r", None),
    "adhoc_filter_clause": ("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus", None),
    "adhoc_isodow": ("SELECT extract(DAYOFWEEK_ISO FROM event_time) AS dow, count(*) AS n FROM access_events GROUP BY 1", SQL + "SELECT isodow(event_time)::int AS dow, count(*) AS n FROM access GROUP BY 1"),
    "adhoc_unhex": ("SELECT decode(unhex('68656c6c6f'), 'UTF-8') AS s, '42'::int AS i", "SELECT decode(unhex('68656c6c6f')) AS s, '42'::int AS i"),
    "adhoc_approx_distinct": ("SELECT o_orderstatus, abs(approx_count_distinct(o_custkey, 0.02) - count(DISTINCT o_custkey)) <= 0.1 * count(DISTINCT o_custkey) AS close FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, true AS close FROM orders GROUP BY 1"),
    "adhoc_percentile": ("SELECT o_orderstatus, percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS med FROM orders GROUP BY o_orderstatus", None),
    "adhoc_cross_join": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a CROSS JOIN nation b WHERE a.n_nationkey < b.n_nationkey", None),
}


def _case(name: str, spark_sql: str, duck: str | None) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        tenant_views(spark, sf_dir, "en" if "$1" in spark_sql else None)
        text = bind_tenant(validate(spark_sql))
        return spark.sql(text, args={"tenant": "en"} if ":tenant" in text else None)

    f.__name__ = name
    query(name, duck or spark_sql)(f)


for _name, (_s, _d) in CASES.items():
    _case(_name, _s, _d)


#: The shares that parts of one size are dealt to, and the tasks of the join.
SHARES, TASKS = 16, 96
#: An event that is in a size's range at all is in that of its whole part, so the others go before the join. The pairs
#: are far more than the rows on either side, so the join's tasks are set and not made from the size of its input.
RANGE_JOIN = f"""WITH e AS (SELECT event_id, floor(value) AS size FROM access_events WHERE value < floor(value) + 0.02),
 shares AS (SELECT /*+ REPARTITION({TASKS}, size, share) */ * FROM (SELECT event_id, size, explode(sequence(0, {SHARES - 1})) AS share FROM e)),
 p AS (SELECT /*+ REPARTITION({TASKS}, size, share) */ * FROM (SELECT p_partkey, cast(p_size AS bigint) AS size, cast(pmod(xxhash64(p_partkey), {SHARES}) AS int) AS share FROM part))
 SELECT event_id, p_partkey FROM shares JOIN p USING (size, share)"""


@query("adhoc_range_join", SQL + "SELECT e.event_id, p.p_partkey FROM access e JOIN part p ON e.value >= p.p_size AND e.value < p.p_size + 0.02")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose value lies just above a part's size, with all those parts."""
    tenant_views(spark, sf_dir, None)
    return run_guarded(spark, RANGE_JOIN, limit=None)


@query("adhoc_asof_join", SQL + "SELECT w.event_id, r.event_id AS last_read FROM access w ASOF JOIN (SELECT * FROM access WHERE action = 'read') r ON w.user_name = r.user_name AND w.event_time > r.event_time WHERE w.action = 'write'")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each write with the user's last read before it: both sides in one ordered window, no pairs are made."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    a = access_events(spark, sf_dir).where(F.col("action").isin("read", "write"))
    # strictly earlier: the window ends before the row's own time
    w = Window.partitionBy("user_name").orderBy(F.unix_micros("event_time")).rangeBetween(Window.unboundedPreceding, -1)
    read = F.max(F.when(F.col("action") == "read", F.struct("event_time", "event_id"))).over(w)
    return a.withColumn("r", read).where("action = 'write' and r is not null").select("event_id", F.col("r.event_id").alias("last_read"))


@query("adhoc_row_cap", SQL + "SELECT count(*) AS n, true AS truncated FROM (SELECT * FROM access LIMIT 101)")
def row_cap(spark, sf_dir):
    from pyspark.sql import functions as F

    tenant_views(spark, sf_dir, None)
    got = run_guarded(spark, "SELECT event_id FROM access_events", limit=100)
    return got.agg(F.count("*").alias("n")).withColumn("truncated", F.col("n") > 100)
