"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded hash; pass 2 runs a
Fisher-Yates shuffle (Spark's shuffle(array, seed)) inside every bucket. That function's generator also
takes the number of the task; bucket and task are therefore dealt by a number of partitions that the count of
rows fixes, so that the seed alone fixes the order, whatever the session's settings. A record's global
position is its bucket's offset plus its place there; position p goes to shard p mod S at slot p div S, so
shard sizes differ by one at most (law `rows`) and slots have no gaps.

Nulls and edge cases: a null text has size 1 and the crc32 of no bytes; a null id is an id like others;
identical rows travel as records of up to COPIES with their number, each to a bucket of its own, so that copies
of one row can't fill a bucket; in the bucket they are records like others; an empty table gives an empty
result; other columns stay where they are (write_shards carries them, and fails if they are named as its own
`shard` and `slot`, unless other names are given).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut, table

#: Records a bucket holds on average; about 60 bytes each while it is shuffled.
BUCKET_RECORDS = 32_768
#: Copies of one row that go to one bucket together.
COPIES = 256


def digests(df: DataFrame, text: str = "text") -> list[Column]:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return [(F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32")]


def assign(df: DataFrame, shards: int = 8, seed: int = 17, key: str = "doc_id", text: str = "text", bucket_records: int = BUCKET_RECORDS) -> DataFrame:
    """One row per row of df: key, size, text_crc32, shard, slot."""
    rows = df.select(F.col(key).alias("k"), *digests(df, text))
    # copies of a row become one record; the partial counts are made before the shuffle
    records = rows.groupBy("k", "size", "text_crc32").agg(F.count("*").alias("n"))
    n_buckets = max(1, -(-df.count() // bucket_records))
    part = F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")).alias("part")
    records = records.select("k", "size", "text_crc32", "n", part).withColumn("n", F.expr(f"cast(least(n - part * {COPIES}, {COPIES}) as int)"))
    scattered = records.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "k", "size", "text_crc32", "part"), F.lit(n_buckets)))
    # an explicit number of partitions: a bucket's task has the same number in every run
    packed = scattered.repartition(n_buckets, "bucket").groupBy("bucket").agg(
        # the list arrives in no fixed order; sorted first, a seed fixes the shuffle
        F.sort_array(F.collect_list(F.struct("k", "size", "text_crc32", "part", "n"))).alias("records"),
    )
    single = F.expr("flatten(transform(records, r -> array_repeat(named_struct('k', r.k, 'size', r.size, 'text_crc32', r.text_crc32), r.n)))")
    # the generator goes from a task's bucket to its next one: their order is fixed too
    packed = cut(packed.withColumn("records", single).sortWithinPartitions("bucket").withColumn("records", F.expr(f"shuffle(records, {seed})")))
    sizes = packed.select("bucket", F.size("records").cast("long").alias("rows"))
    from pyspark.sql import Window

    # one row per bucket: rows / BUCKET_RECORDS of them
    offsets = sizes.select("bucket", (F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")).alias("offset"))
    out = packed.join(offsets, "bucket").select("offset", F.posexplode("records").alias("place", "x")).select("x.*", (F.col("offset") + F.col("place")).alias("p"))
    return out.select(
        F.col("k").alias(key), "size", "text_crc32",
        F.pmod("p", F.lit(shards)).cast("int").alias("shard"), F.expr(f"p div {shards}").alias("slot"),
    )


def write_shards(df: DataFrame, path: str, shards: int = 8, seed: int = 17, key: str = "doc_id", text: str = "text", shard: str = "shard", slot: str = "slot") -> None:
    """Write whole rows to path/shard=N in slot order. Rows are matched by key, size and checksum."""
    if {shard, slot} & set(df.columns):
        raise ValueError(f"name the columns of shard and slot otherwise: df has {shard} or {slot}")
    marks = ("__k", "__size", "__crc", "__nth")
    nth = lambda cols: F.expr(f"row_number() over (partition by {', '.join(cols)} order by 1)")
    placed = assign(df, shards, seed, key, text).select(F.col(key).alias("__k"), F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    placed = placed.withColumn("__nth", nth(marks[:3]))
    d = digests(df, text)
    rows = df.select("*", F.col(key).alias("__k"), d[0].alias("__size"), d[1].alias("__crc")).withColumn("__nth", nth(marks[:3]))
    same = [rows[m].eqNullSafe(placed[m]) for m in marks]
    joined = rows.join(placed, same[0] & same[1] & same[2] & same[3]).drop(*[placed[m] for m in marks]).drop(*marks)
    (joined.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
     .withColumnRenamed("__slot", slot).withColumnRenamed("__shard", shard)
     .write.mode("overwrite").partitionBy(shard).parquet(path))


def op8(spark, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
