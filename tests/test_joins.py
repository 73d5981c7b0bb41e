"""As-of and interval joins, identities, dictionaries, sketches, fan-out and table functions against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import detect, dictionary, fanout, identities, ordered, table_functions
from tessera.plans import adhoc, sketches

START = datetime(2024, 1, 1)


def times(rng, n, keys, span):
    return [(i, rng.choice(keys), START + timedelta(seconds=rng.randrange(span))) for i in range(n)]


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("keys,span", [(["u"], 4000), (["u", "v", "w"], 60), ([f"k{i}" for i in range(90)], 500), (["", "x", None], 300)])
def test_asof(spark, strict, keys, span):
    rng = random.Random(span)
    left, right = times(rng, 400, keys, span), times(rng, 150, keys, span)
    schema = "id long, key string, at timestamp"
    df = lambda rows: spark.createDataFrame(rows, schema).repartition(5)
    got = {r.id: r.right for r in ordered.asof_join(df(left), df(right), "key", "at", tie=("id",), strict=strict).collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        fits = [(u, j) for j, q, u in right if k is not None and q == k and (u < t if strict else u <= t)]
        assert (got[i] and (got[i]["at"], got[i]["id"])) == (max(fits) if fits else None)


def test_asof_spreads_one_key(spark):
    """All rows of one key: several tasks have rows, and the first rows of each take the match of an earlier range."""
    rows = [(i, "one", START + timedelta(seconds=i)) for i in range(4000)]
    left = spark.createDataFrame(rows, "id long, key string, at timestamp")
    right = left.where("id = 3 or id = 1700")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.asof_join(left, right, "key", "at", strict=False)
        assert got.rdd.getNumPartitions() > 1
        assert {(r.id, r.right and r.right.id) for r in got.collect()} == {(i, None if i < 3 else 3 if i < 1700 else 1700) for i in range(4000)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert ordered.asof_join(left.limit(0), right, "key", "at").count() == 0
    assert ordered.asof_join(left.limit(5), right.limit(0), "key", "at").where("right is null").count() == 5


def test_interval_join(spark):
    rng = random.Random(2)
    rows = lambda n: [(i, rng.randrange(3), s := rng.uniform(-500, 500), s + rng.choice((0, 0.5, 3, 40, 900, -1))) for i in range(n)]
    a, b = rows(120), rows(90)
    schema = "id long, g int, s double, e double"
    for by in ((), ("g",)):
        got = ordered.interval_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ("s", "e"), ("s", "e"), 2.0, by).select("a.id", F.col("b.id").alias("other")).collect()
        want = sorted((x[0], y[0]) for x in a for y in b if x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3] and (not by or x[1] == y[1]))
        assert sorted(map(tuple, got)) == want and want
    assert ordered.interval_join(spark.createDataFrame([], schema), spark.createDataFrame(b, schema), ("s", "e"), ("s", "e"), 2.0).count() == 0


def brute_identities(rows, hub, many):
    docs, seen = {}, {}
    for d, m in rows:
        if m is not None:
            seen.setdefault(m, set()).add(d)
            docs.setdefault(d, set()).add(m)
    up = {m: m for m in seen}

    def top(m):
        while up[m] != m:
            m = up[m]
        return m

    for d, ms in docs.items():
        if len(ms) <= many:
            ms = [m for m in ms if len(seen[m]) <= hub]
            for m in ms[1:]:
                a, b = sorted((top(ms[0]), top(m)))
                up[b] = a
    groups = {}
    for m in seen:
        groups.setdefault(top(m), []).append(m)
    out = []
    for ms in groups.values():
        best = min(ms, key=lambda m: (-len(seen[m]), m))
        out += [(m, len(seen[m]), min(ms), best, len(ms)) for m in ms]
    return sorted(out)


def test_identities(spark):
    rng = random.Random(3)
    rows = [(i, f"m{i:04d}") for i in range(80)] + [(i, f"m{i + 1:04d}") for i in range(80)]  # a long chain
    rows += [(1000 + i, "hub") for i in range(9)] + [(1000 + i, f"own{i}") for i in range(9)]
    rows += [(2000, f"list{i}") for i in range(9)] + [(3000 + rng.randrange(40), f"r{rng.randrange(60)}") for _ in range(60)]
    rows += [(4000, None), (5, "m0005"), (5, "m0005")]
    df = spark.createDataFrame(rows, "doc_id long, mention string")
    got = sorted(map(tuple, identities.resolved(df, hub=8, many=8).select("mention", "n_docs", "entity", "canonical", "n_mentions").collect()))
    assert got == brute_identities(rows, 8, 8)
    assert max(r[4] for r in got) >= 81 and ("hub", 9, "hub", "hub", 1) in got
    assert identities.resolved(df.limit(0)).count() == 0


def test_dictionary(spark, tmp_path):
    terms = [("Heart Attack", "c"), ("heart", "b"), ("attack of the", "a"), ("the", "z"), ("heart-attack", "b"), ("", "x"), ("one two three four", "d")]
    dictionary.build(spark.createDataFrame(terms, "term string, category string"), str(tmp_path / "d"))
    d = dictionary.load(spark, str(tmp_path / "d"))
    assert {(r.term, r.length, r.category) for r in d.collect()} == {("heart attack", 2, "b"), ("heart", 1, "b"), ("attack of the", 3, "a"), ("the", 1, "z"), ("one two three four", 4, "d")}
    docs = spark.createDataFrame([(1, "The HEART attack of the heart"), (2, None), (3, "one two three"), (4, "attack of the heart attack"), (4, "x one two three four")], "doc_id long, text string")
    got = sorted(map(tuple, dictionary.matches(docs, d).collect()))
    assert got == [(1, 0, "the", "z"), (1, 1, "heart attack", "b"), (1, 2, "attack of the", "a"), (1, 4, "the", "z"), (1, 5, "heart", "b"), (4, 0, "attack of the", "a"), (4, 1, "one two three four", "d"), (4, 2, "the", "z"), (4, 3, "heart attack", "b")]
    plan = dictionary.matches(docs, d)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "rlike" not in plan.lower()


def test_a_dictionary_of_a_hundred_thousand_terms(spark, tmp_path):
    w = lambda i: F.concat(F.lit("t"), i.cast("string"))
    terms = spark.range(100_000).select(F.concat_ws(" ", w(F.col("id") % 1000), w(F.col("id"))).alias("term"), (F.col("id") % 7).alias("category"))
    dictionary.build(terms, str(tmp_path / "d"))
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat_ws(" ", w(F.col("id")), w(F.col("id") + 5000), w(F.col("id") + 6000), w(F.lit(3)), w(F.lit(99_003))).alias("text"))
    got = dictionary.matches(docs, dictionary.load(spark, str(tmp_path / "d"))).collect()
    assert {(r.doc_id, r.position) for r in got} == {(i, p) for i in range(50) for p in (0, 3)}


def test_sketches_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 13).alias("day"), (F.col("id") % 3001).alias("user"), (F.col("id") % 1000).alias("v"))
    states = sketches.rollup(df, ("day",), "user", "v")
    whole, half = sketches.merged(states).first(), sketches.merged(states.where("day < 6"), ("day",)).count()
    assert whole.n == 20_000 and abs(whole.distinct - 3001) <= sketches.COUNT_ERROR * 3001 and half == 6
    assert abs(whole.q50 - 500) <= 1000 * sketches.RANK_ERROR and abs(whole.q90 - 900) <= 1000 * sketches.RANK_ERROR


def test_fan_out(spark):
    assert [fanout.ranges(n) for n in (0, 9_999, 10_000, 12_500, 10**7)] == [1, 1, 10, 12, 16]
    skew = spark.range(30_000).select(F.when(F.col("id") % 10 < 9, F.format_string("/big/%06d", "id")).otherwise(F.format_string("/s%d/%06d", F.col("id") % 5, "id")).alias("p"))
    sizes = [r["count"] for r in fanout.fan_out(skew, "p").groupBy("part").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * 30_000 / 16
    few = spark.range(20_000).select(F.concat(F.lit("/"), (F.col("id") % 3).cast("string"), F.lit("/x")).alias("p"))  # three keys only
    parts = fanout.fan_out(few, "p").groupBy("p").agg(F.count_distinct("part").alias("n")).collect()
    assert [r.n for r in parts] == [1, 1, 1]
    assert fanout.fan_out(few.limit(5).withColumn("p", F.lit(None).cast("string")), "p", parted_from=1).where("part is null").count() == 0


def test_table_functions(spark):
    table_functions.register(spark)
    spark.createDataFrame([(1, "mail a@b.co"), (2, None), (3, "x " * 5000)], "doc_id long, text string").createOrReplaceTempView("docs")
    got = adhoc.run_guarded(spark, "SELECT * FROM tessera_chunks(TABLE(SELECT doc_id, text FROM docs) PARTITION BY doc_id)").collect()
    want = [(i, k, *c) for i, t in ((1, "mail a@b.co"), (3, "x " * 5000)) for k, c in enumerate(detect.chunks(t))]
    assert sorted(map(tuple, got)) == want and len(want) == 4
    spans = adhoc.run_guarded(spark, "SELECT value FROM tessera_spans(TABLE(docs) PARTITION BY doc_id) WHERE entity_type = 'EMAIL'").collect()
    assert [r.value for r in spans] == ["a@b.co"]


def test_arrow_fetch(spark):
    spark.range(30).createOrReplaceTempView("numbers")
    rows, cut = adhoc.fetch_arrow(spark, "SELECT id FROM numbers ORDER BY id", limit=10)
    assert rows.column("id").to_pylist() == list(range(10)) and cut
    rows, cut = adhoc.fetch_arrow(spark, "SELECT id FROM numbers", limit=30)
    assert rows.num_rows == 30 and not cut
