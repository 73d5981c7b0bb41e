"""What made queries fail or crawl on large tables, on small ones."""

import random
import time

import duckdb
import pandas as pd

from tessera import registry
from tessera.operators import ordered
from tessera.plans import relational
from tessera.streaming import scan_trigger as G
from tessera.streaming import streams, trigger_queries

DATA = "/root/testdata/sf0.001"


def test_tree_depth_has_no_limit_of_rows(spark):
    """More directories than a recursive query may make."""
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "50")
    try:
        got = sorted(map(tuple, registry.queries()["tree_depth_recursive"](spark, DATA).collect()))
    finally:
        spark.conf.set(limit, before)
    keys = [r.p_partkey for r in spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey").collect()]
    assert len(keys) > 50
    assert got == sorted((d, n) for d in range(20) if (n := sum(len(str(k)) == d + 1 for k in keys)))


def test_tree_depths(spark):
    """Directories named twice, under one parent or several, and such as no root reaches."""
    rng = random.Random(8)
    tree = [(i, None if i < 3 else rng.randrange(i)) for i in range(60) for _ in range(rng.choice((1, 1, 2)))] + [(1000, 1001), (1001, 1000), (None, None), (7, 2)]
    want, level = [], [r for r, p in tree if p is None]
    while level:
        want.append((len(want), len(level)))
        level = [r for above in level for r, p in tree if p is not None and p == above]
    got = relational.depths(spark.createDataFrame(tree, "dir_ref long, parent_ref long"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 3
    assert got.dtypes == [("depth", "int"), ("n", "bigint")]
    assert relational.depths(spark.createDataFrame([], "dir_ref long, parent_ref long")).count() == 0


def test_limit_does_not_go_through_moments_without_room():
    """Scans that wait for years, asked every hour: seconds of work, however long they wait."""
    rng, s = random.Random(9), G.SECOND
    scans = [(d := rng.randrange(30 * 86400 * s), rng.randrange(3), d, f"/f{i}", 1) for i in range(20_000)]
    began = time.process_time()
    done, left, _ = G.limited(scans, [], 10**17, 4, 6 * 3600 * s, 3600 * s)
    assert time.process_time() - began < 30 and not left
    assert sorted(d[2:5] for d in done) == sorted(w[2:5] for w in scans)
    at = [d[-1] for d in done]
    assert at == sorted(at) and all(b - a >= 6 * 3600 * s for a, b in zip(at, at[4:])) and all((d[-1] - d[2]) % (3600 * s) == 0 for d in done)


def test_limit_in_parts_with_others_between():
    """Equal moments and ranks, several parts, scans that come while others wait: as a plain heap gives them."""
    rng = random.Random(10)
    for _ in range(300):
        most, seconds, retry = rng.choice((1, 2, 5)), rng.choice((1, 9, 40)), rng.choice((1, 3, 7, 50))
        scans = [(d := rng.randrange(80), rng.randrange(3), d, f"f{i}", 1) for i in range(rng.randrange(40))]
        want, heap, sent = [], list(scans), []
        while heap:
            now = min(heap)[0]
            for w in sorted((w for w in heap if w[0] == now), key=lambda w: w[1:]):
                heap.remove(w)
                if sum(now - t < seconds for t in sent) < most:
                    sent.append(now)
                    want.append((*w, now))
                else:
                    heap.append((now + retry, *w[1:]))
        done, left, sent, before = [], [], [], -1
        for until in (*sorted(rng.randrange(200) for _ in range(3)), 10**6):
            more, left, sent = G.limited(left + [w for w in scans if before < w[0] <= until], sent, until, most, seconds, retry)
            done, before = done + more, until
        assert done == want and not left


def test_scans_that_wait_for_centuries_are_dispatched(spark):
    """The stream ends when the last scan has had its turn, here after 2262."""
    days = 12000
    c = duckdb.connect()
    for t in ("documents", "labels", "events"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    theirs = c.sql(f"select file_path, risk_tier, epoch_us(due), epoch_us(dispatched), n from ({trigger_queries._sql(1, days * 86400, days * 43200)})").fetchall()
    ours = trigger_queries.triggered(spark, DATA, "trigger-long", 1, days * 86400, days * 43200)
    got = ours.selectExpr("file_path", "risk_tier", "unix_micros(due)", "unix_micros(dispatched)", "n").collect()
    assert sorted(map(tuple, got)) == sorted(theirs)
    assert max(r[3] for r in theirs) > 9_300_000_000 * 10**6


def test_overlap_sums(spark):
    """Edges that meet, hot places, groups of several rows, and rows of either side that are empty, backward or no numbers."""
    rng, less = random.Random(11), lambda x, y: (x != x, x) < (y != y, y) and x == x
    width = (0, 0, 1, 2, 3, 40, -1, -6, None, float("nan"), float("inf"))
    rows = lambda n: [(i, rng.choice((*range(n // 4), None)), s := rng.choice((float(rng.randrange(20)), 7.0, float("-inf"))), None if (w := rng.choice(width)) is None else s + w) for i in range(n)]
    schema = "id long, g int, s double, e double"
    for n, m in ((300, 200), (40, 0), (0, 40)):
        a, b = rows(n), rows(m)
        want = {}
        for _, g, s, e in a:
            for j, _, t, u in b:
                if e is not None and u is not None and less(s, u) and less(t, e) and less(t, u):
                    want[g] = (want.get(g, (0, 0))[0] + 1, want.get(g, (0, 0))[1] + j)
        got = ordered.overlap_sums(spark.createDataFrame(a, schema).repartition(3), spark.createDataFrame(b, schema), ("s", "e"), ("s", "e"), ("g",), "id").collect()
        assert {r.g: (r.n, r.total) for r in got} == want and len(got) == len(want)


def test_overlaps_are_summed_without_pairs(spark, tmp_path):
    """Sixteen hundred million pairs: more than could be made in a test's time."""
    spark.range(40_000).selectExpr("id as p_partkey", "'x' as p_brand", "1 + cast(id % 50 as int) as p_size", "900.0D as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 40_001).selectExpr("id * 300 + 299 as c_custkey", "700.0D as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.queries()["interval_overlap_join"](spark, str(tmp_path)).selectExpr("count(*) c", "min(n)", "max(n)", "min(keys)", "max(keys)").first()
    keys = sum(300 * i + 299 for i in range(1, 40_001))
    assert tuple(got) == (40_000, 40_000, 40_000, keys, keys)


def test_range_join_meets_only_what_it_returns(spark, tmp_path):
    """Twenty thousand million pairs of one size but for the fraction: all go before the join. Values that fit no integer match nothing."""
    spark.range(40_000).selectExpr("id as p_partkey", "7 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    value = "case when id < 3 then 7.0 + id / 100 when id = 3 then 'NaN' when id = 4 then 'Infinity' when id = 5 then 3e9 when id = 6 then null else 7.5 end"
    spark.range(500_000).selectExpr("id as event_id", "timestamp '2024-01-01' as ts", "id as user_id", "'view' as event_type", f"cast({value} as double) as value").write.parquet(f"{tmp_path}/events.parquet")
    for t in ("documents", "labels", "lineitem", "orders", "customer", "nation"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    got = registry.queries()["adhoc_range_join"](spark, str(tmp_path))
    assert {tuple(r) for r in got.groupBy("event_id").count().collect()} == {(0, 40_000), (1, 40_000)}
    assert got.rdd.getNumPartitions() > 8  # however few rows meet so often


def test_cooldown_gives_its_passes_in_few_frames():
    """A file's passes of a batch come as one frame, not each as a frame of its own; the state goes on to the next batch."""
    class Last:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    rng, last, processor = random.Random(12), None, streams.Cooldown(60)
    processor.last = Last()
    for k in range(3):
        times, want = [float(10**6 * k + rng.randrange(400_000)) for _ in range(20_000)], []
        for at in sorted(times):
            if last is None or at - last >= 60:
                last = at
                want.append(at)
        (frame,) = processor.handleInputRows(("f",), iter([pd.DataFrame({"file_path": "f", "at": times[i::3]}) for i in range(3)]), None)
        assert frame["at"].tolist() == want and set(frame["file_path"]) == {"f"} and len(want) > 1000
