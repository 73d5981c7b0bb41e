"""File trees, committed sinks, change feeds and table versions: pushed filters, retries, replays, crashes and conflicts."""

import json
import os
import stat

import pytest
from pyspark.sql import functions as F

from tessera.sources import changes, files, manifest, sinks
from tessera.sources.lake import Lake
from tessera.streaming.streams import drain


# --- file trees --------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for i in range(60):
        at = root / f"a{i % 3}" / f"b{i % 5}"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"f{i}.{('txt', 'CSV', 'log')[i % 3]}").write_bytes(b"x" * i)
    (root / "top.txt").write_bytes(b"top")
    (root / "noend").write_bytes(b"")
    (root / ".hidden").write_bytes(b"h")
    (root / "empty").mkdir()
    os.chmod(root / "top.txt", 0o640)
    os.symlink(root, root / "a0" / "loop")
    return root


def walked(root):
    return {os.path.join(d, n) for d, _, names in os.walk(root) for n in names if not os.path.islink(os.path.join(d, n))}


@pytest.mark.parametrize("fanout", [1, 4, 64])
def test_listing(spark, tree, fanout):
    files.register(spark)
    rows = spark.read.format("tessera_files").option("fanout", fanout).load(str(tree)).collect()
    assert {r.file_path for r in rows} == walked(tree) and len(rows) == 63
    top = next(r for r in rows if r.file_name == "top.txt")
    s = os.stat(tree / "top.txt")
    assert (top.file_size, top.mode, top.folder, top.extension) == (3, 0o640, str(tree), "txt") and top.owner and top.group
    assert abs(top.file_modified.timestamp() - s.st_mtime) < 1e-3
    assert {r.extension for r in rows} == {"txt", "csv", "log", None}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_are_pushed(spark, tree):
    df = files.list_tree(spark, str(tree))
    prefix = f"{tree}/a1/"
    got = df.where(F.col("file_path").startswith(prefix) & (F.col("file_size") > 10) & F.col("extension").isin("csv", "txt"))
    want = {p for p in walked(tree) if p.startswith(prefix) and os.path.getsize(p) > 10 and p.lower().endswith((".csv", ".txt"))}
    assert {r.file_path for r in got.collect()} == want and want
    shown = plan(got)
    assert "Filter" not in shown.split("BatchScan")[0].replace("PushedFilters", "")  # nothing is left to Spark
    assert {r.file_path for r in df.where(F.col("folder") == f"{tree}/a1/b1").collect()} == {p for p in walked(tree) if os.path.dirname(p) == f"{tree}/a1/b1"}
    assert df.where(F.col("file_path") == f"{tree}/top.txt").count() == 1
    assert df.where("extension = 'csv' and extension = 'txt'").count() == 0
    assert df.where("file_size between 5 and 7").count() == 3
    assert df.where("extension is null").count() == 2  # not taken over: left to Spark
    assert df.where(F.col("file_modified") > F.lit("2000-01-01").cast("timestamp")).count() == 63


def test_a_pushed_prefix_opens_no_other_folder(tree):
    wanted = files.Wanted()
    assert wanted.take(files.StringStartsWith(("file_path",), f"{tree}/a1/b"))
    assert wanted.opens(str(tree)) and wanted.opens(f"{tree}/a1") and wanted.opens(f"{tree}/a1/b2") and not wanted.opens(f"{tree}/a2") and not wanted.opens(f"{tree}/a1/c")
    reader = files.FilesReader({"path": str(tree)}, None)
    assert list(reader.pushFilters([files.StringStartsWith(("folder",), f"{tree}/a2")])) == []
    assert {d for p in reader.partitions() for d, _ in p.value} <= {str(tree), f"{tree}/a2", *[f"{tree}/a2/b{i}" for i in range(5)]}


def test_folders(spark, tree):
    rows = {r.folder: r for r in files.list_folders(spark, str(tree)).collect()}
    assert set(rows) == {d for d, _, _ in os.walk(tree)} and rows[str(tree)].parent is None
    assert rows[f"{tree}/a0/b0"].n_files == 4 and rows[f"{tree}/a0/b0"].depth == 2 and rows[f"{tree}/a0/b0"].parent == f"{tree}/a0"
    assert stat.S_IMODE(os.stat(tree / "empty").st_mode) == rows[f"{tree}/empty"].mode and rows[f"{tree}/empty"].n_files == 0


def test_contents_put_and_removed(spark, tmp_path):
    rows = [(f"d{i % 4}/n{i}.bin", bytes([i]) * i) for i in range(30)] + [("empty", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    files.put_files(df, str(tmp_path))
    files.put_files(df, str(tmp_path))  # the same again: the same files
    got = files.list_tree(spark, str(tmp_path), contents=True)
    assert {(os.path.relpath(r.file_path, tmp_path), bytes(r.content)) for r in got.collect()} == {(p, c or b"") for p, c in rows}
    small = spark.read.format("tessera_files").option("kind", "contents").option("maxBytes", 5).load(str(tmp_path))
    assert small.where("content is null").count() == 24
    assert files.remove_files(got.where("extension = 'bin'"), str(tmp_path)) == 30 and walked(tmp_path) == {str(tmp_path / "empty")}
    with pytest.raises(Exception, match="leaves the root"):
        files.put_files(spark.createDataFrame([("../out", b"")], "path string, content binary"), str(tmp_path))
    with pytest.raises(Exception, match="leaves the root"):
        files.remove_files(spark.createDataFrame([("/etc/hosts",)], "file_path string"), str(tmp_path))
    with pytest.raises(Exception, match="kind"):
        spark.read.format("tessera_files").option("kind", "odd").load(str(tmp_path))


# --- sinks -------------------------------------------------------------------------------------------
def test_sink_commits_and_cursor(spark, tmp_path):
    at = str(tmp_path)
    day = lambda n: spark.range(n).select(F.concat(F.lit("line "), F.col("id")).alias("line"), F.format_string("2024-01-%02d", F.col("id") + 1).alias("cursor")).repartition(3)
    assert sinks.send_since(day(10), at, "siem") == 10 and sinks.cursor(at, "siem") == "2024-01-10"
    assert sinks.send_since(day(14), at, "siem") == 4 and sinks.cursor(at, "siem") == "2024-01-14"
    assert sinks.send_since(day(14), at, "siem") == 0 and sinks.cursor(at, "siem") == "2024-01-14"
    assert sorted(r.line for r in sinks.sent(spark, at, "siem").collect()) == sorted(f"line {i}" for i in range(14))
    assert sinks.cursor(at, "other") is None and sinks.sent(spark, at, "other").count() == 0
    sinks.send(day(5), at, "named", batch="b1")
    sinks.send(day(7), at, "named", batch="b1")  # sent before
    assert sinks.sent(spark, at, "named").count() == 5
    with pytest.raises(Exception, match="no name"):
        sinks.send(day(1), at, "../x")


def test_a_retried_task_leaves_no_line_twice(spark, tmp_path):
    """A first attempt that dies, one that ends and is not in the commit, a batch whose commit runs twice, and an abort."""
    from pyspark.sql import Row
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("line", T.StringType())])
    rows = [Row(line=f"l{i}") for i in range(5)] + [Row(line=None)]

    def dies():
        yield from rows[:3]
        raise OSError("executor lost")

    writer = sinks.StreamLines({"path": str(tmp_path), "sink": "s"}, schema)
    with pytest.raises(OSError):
        writer.write(dies())
    assert not [n for n in os.listdir(tmp_path / "s") if n.startswith("part")]
    writer.write(iter(rows))  # a speculative attempt: nobody commits it
    good = writer.write(iter(rows))
    writer.commit([good, None], 0)
    again = writer.write(iter(rows))
    writer.commit([again], 0)  # the batch was replayed after a crash
    writer.abort([writer.write(iter(rows))], 1)
    assert sorted(r.line for r in sinks.sent(spark, str(tmp_path), "s").collect()) == [f"l{i}" for i in range(5)]
    assert [m["batch"] for m in sinks.manifests(str(tmp_path / "s"))] == ["stream-000000000000"]


def test_sink_of_a_stream_restarts(spark, tmp_path):
    spark.dataSource.register(sinks.Sink)

    def run():
        lines = spark.readStream.schema("line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = lines.writeStream.format("tessera_sink").option("path", str(tmp_path)).option("sink", "s").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    for k in range(2):
        spark.range(k * 10, k * 10 + 10).select(F.col("id").cast("string").alias("line")).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    run()
    assert sorted(int(r.line) for r in sinks.sent(spark, str(tmp_path), "s").collect()) == list(range(20))


# --- change feeds --------------------------------------------------------------------------------------
def change(i, **more):
    return {"id": str(i), "name": f"f{i}.txt", "parentReference": {"path": "/drive/root:/docs"}, "lastModifiedDateTime": "2024-01-01T00:00:00Z", "lastModifiedBy": {"user": {"displayName": "ann"}}} | more


def take(spark, path, cp, out, **options):
    """Run a feed until it has caught up; the pages of each batch."""
    batches = []

    def each(df, number):
        rows = changes.file_events(df).collect()
        batches.append(sorted({r.page for r in rows}))
        with open(out, "a", encoding="utf-8") as f:
            f.writelines(json.dumps([r.page, r.file_path]) + "\n" for r in rows)

    q = changes.feed(spark, path, **options).writeStream.foreachBatch(each).option("checkpointLocation", cp).start()
    q.processAllAvailable()
    q.stop()
    return [b for b in batches if b]


def test_feed_once_each_over_two_runs(spark, tmp_path):
    path, cp, out = str(tmp_path / "feed"), str(tmp_path / "cp"), str(tmp_path / "out")
    os.makedirs(path)
    for n in range(5):
        changes.put_page(path, n, [change(10 * n + k) for k in range(3)])
    first = take(spark, path, cp, out, maxPages=2)
    assert first == [[0, 1], [2, 3], [4]]
    for n in range(5, 8):
        changes.put_page(path, n, [change(10 * n)])
    assert take(spark, path, cp, out, maxPages=2) == [[5, 6], [7]]
    seen = [json.loads(x) for x in open(out, encoding="utf-8")]
    assert sorted(seen) == sorted([n, f"/docs/f{10 * n + k}.txt"] for n in range(8) for k in range(3 if n < 5 else 1))


def test_feed_replays_a_failed_batch(spark, tmp_path):
    path, cp = str(tmp_path / "feed"), str(tmp_path / "cp")
    os.makedirs(path)
    for n in range(3):
        changes.put_page(path, n, [change(n)])
    got = []

    def fails(df, number):
        raise RuntimeError("lost")

    q = changes.feed(spark, path, maxPages=2).writeStream.foreachBatch(fails).option("checkpointLocation", cp).start()
    with pytest.raises(Exception, match="lost"):
        q.processAllAvailable()
    changes.put_page(path, 3, [change(3)])
    q = changes.feed(spark, path, maxPages=2).writeStream.foreachBatch(lambda df, n: got.append(sorted(r.page for r in df.collect()))).option("checkpointLocation", cp).start()
    q.processAllAvailable()
    q.stop()
    assert got == [[0, 1], [2, 3]]


def test_bounded_queue_drops_the_latest(spark, tmp_path):
    path, cp, out = str(tmp_path / "feed"), str(tmp_path / "cp"), str(tmp_path / "out")
    os.makedirs(path)
    for n in range(7):
        changes.put_page(path, n, [change(n)])
    assert take(spark, path, cp, out, queue=4, overflow="drop") == [[0, 1, 2, 3]]
    changes.put_page(path, 7, [change(7)])
    assert take(spark, path, cp, out, queue=4, overflow="drop") == [[7]]
    reader = changes.Pages({"path": path, "queue": "4", "overflow": "drop"})
    assert [n for n, _ in reader.readBetweenOffsets({"page": -1}, {"page": 6})] == [0, 1, 2, 3]


def test_items_that_make_no_event(spark):
    rows = [change(1), change(2, folder={}), change(3, deleted={"state": "deleted"}), change(4, name=""), change(5, lastModifiedBy={"user": {"email": "a@b.co", "displayName": "ann"}}), {"id": "6", "name": "bare"}]
    df = spark.createDataFrame([(0, json.dumps(r)) for r in rows], "page long, item string")
    got = {(r.file_path, r.user_name, r.event_time is None) for r in changes.file_events(df).collect()}
    assert got == {("/docs/f1.txt", "ann", False), ("/docs/f5.txt", "a@b.co", False), ("/bare", None, True)}


# --- versions ------------------------------------------------------------------------------------------
def results(spark, n, day="2024-01-01", job="j"):
    return spark.range(n).select(F.col("id").cast("string").alias("file_path"), F.col("id").cast("int").alias("risk_score"), F.md5(F.lit(job)).alias("job_id"), F.lit("t").alias("tenant"), F.lit("a/b c").alias("target"), F.lit(day).cast("date").alias("scan_date"))


def test_log(spark, tmp_path):
    log = manifest.Log(manifest.Store(spark, str(tmp_path)), "t")
    assert log.read().number == 0
    for i in range(25):
        log.commit({f"f{i}": i}, [f"f{i - 5}"] if i >= 5 else (), notes={"n": str(i)})
    now = log.read()
    assert now.number == 25 and sorted(now.files) == [f"f{i}" for i in range(20, 25)] and now.notes == {"n": "24"}
    assert sorted(log.read(3).files) == ["f0", "f1", "f2"]
    with pytest.raises(manifest.Conflict):
        log.commit({}, ["f3"])
    with pytest.raises(ValueError):
        log.read(99)


def test_two_writers_of_one_version(spark, tmp_path):
    """The loser of a version reads again and commits the next one; one that would remove what is gone fails."""
    store = manifest.Store(spark, str(tmp_path))
    log = manifest.Log(store, "t")
    log.commit({"a": 1})
    read, raced = log.read, []

    def late(number=None):
        now = read(number)
        if not raced:
            raced.append(1)
            manifest.Log(store, "t").commit({"b": 1}, ["a"])
        return now

    log.read = late
    assert log.commit({"c": 1}).number == 3
    raced.clear()
    manifest.Log(store, "t").commit({"a": 1})
    raced.append(1)
    stale = read()
    manifest.Log(store, "t").commit({}, ["a"])
    with pytest.raises(manifest.Conflict):
        log.commit({"d": 1}, [f for f in stale.files if f == "a"])
    assert sorted(manifest.Log(store, "t").read().files) == ["b", "c"]
    with pytest.raises(FileExistsError):
        store.write_bytes("t/_versions/000000000001.json", b"{}", replace=False)
    store.write_bytes("x", b"1")
    store.write_bytes("x", b"2")
    assert store.read_bytes("x") == b"2" and store.delete("x") and not store.exists("x")


def test_compaction_under_a_running_reader(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    for k in range(4):
        lake.append(results(spark, 10, job=str(k)), "scan_results")
    before = lake.read("scan_results")
    assert lake.compact("scan_results", threshold=3) and list(lake.leaves("scan_results").values()) == [1]
    assert before.count() == 40 == lake.read("scan_results").count()  # its files are there until vacuum
    assert lake.read("scan_results", version=2).count() == 20
    assert len(lake.vacuum("scan_results", older_ms=0)) == 4 and lake.read("scan_results").count() == 40
    assert lake.read("scan_results").first().target == "a/b c"


def test_a_crash_before_the_swap_shows_nothing(spark, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path))
    for k in range(3):
        lake.append(results(spark, 10), "scan_results")
    monkeypatch.setattr(manifest.Log, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    for act in (lambda: lake.compact("scan_results", 2), lambda: lake.append(results(spark, 5), "scan_results"), lambda: lake.delete_where("scan_results", "risk_score < 5")):
        with pytest.raises(RuntimeError):
            act()
        assert lake.read("scan_results").count() == 30
    monkeypatch.undo()
    assert len(lake.vacuum("scan_results", older_ms=0)) >= 2
    assert lake.read("scan_results").count() == 30 and lake.compact("scan_results", 2)


def test_delete_rewrites_only_what_is_hit(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.append(results(spark, 10, "2024-01-01", "a"), "scan_results")
    lake.append(results(spark, 10, "2024-01-01", "b"), "scan_results")
    lake.append(results(spark, 10, "2024-01-02", "c"), "scan_results")
    kept = {f for f in lake.log("scan_results").read().files}
    job = F.md5(F.lit("a"))
    assert lake.delete_where("scan_results", F.lower(F.hex("job_id")) == job) == 1
    assert lake.read("scan_results").count() == 20 and len(kept & set(lake.log("scan_results").read().files)) == 2
    assert lake.delete_where("scan_results", "risk_score = 0") == 2 and lake.read("scan_results").count() == 18
    assert lake.delete_where("scan_results", "risk_score = 99") == 0 and lake.delete_where("access_events", "true") == 0


def test_flush_and_batches_are_exactly_once(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    events = lambda n: spark.range(n).select(F.col("id").cast("string").alias("file_path"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("event_time"), F.lit("t").alias("tenant"), F.lit("2024-01-01").cast("date").alias("event_date"))
    assert [lake.flush(events(n), "access_events", "event_time") for n in (5, 5, 12)] == [5, 0, 7]
    assert Lake(spark, str(tmp_path)).flush(events(12), "access_events", "event_time") == 0  # the cursor is in the table
    assert lake.read("access_events").count() == 12
    assert [lake.append_once(events(3), "access_events", "s", b) for b in (0, 0, 1)] == [True, False, True]
    assert lake.read("access_events").count() == 18
    spark.range(8).select("id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    each = lambda df, b: lake.append_once(df.select(F.col("id").cast("string").alias("file_path"), F.lit("t").alias("tenant"), F.lit("2024-01-03").cast("date").alias("event_date")), "access_events", "q", b)
    drain(stream, str(tmp_path / "cp"), each=each)
    assert lake.read("access_events").count() == 26


def test_snapshot_replaces_its_partitions(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.snapshot(results(spark, 10, "2024-01-01").unionByName(results(spark, 10, "2024-01-02")), "scan_results")
    lake.snapshot(results(spark, 3, "2024-01-02"), "scan_results")
    assert {(str(r.scan_date), r["count"]) for r in lake.read("scan_results").groupBy("scan_date").count().collect()} == {("2024-01-01", 10), ("2024-01-02", 3)}
