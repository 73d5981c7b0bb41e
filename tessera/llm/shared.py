"""Helpers of the operators: tables, checkpoints, row keys and Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker holds as vectors at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18
#: Rows of one key that a task takes without being dealt more of them than others are.
HOT_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data, set as the checkpoint folder too: the one that the session names.
    Only a session without executors of its own may fall back to a folder of the machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df from reliable storage: the lineage ends at files that every executor can read again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_keys(counted: DataFrame, key: str, n: str, total: int) -> DataFrame | None:
    """key, __salts of the keys with more than a thousandth of all rows (HOT_ROWS at least), so a thousand rows at
    most, from one row per key with its count n. A key's rows are to be dealt over so many salts. None where the
    total is too small for any."""
    floor = max(HOT_ROWS, total // 1000)
    if total <= floor:
        return None
    return counted.where(F.col(n) > floor).select(key, F.ceil(F.col(n) / floor).cast("int").alias("__salts"))


def salted_join(big: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, by: Column) -> DataFrame:
    """big with the columns of one (a row per key), where the rows of a hot key are dealt by `by` over several
    tasks. hot is the table of hot_keys, small enough to be sent to all tasks whatever the size of big."""
    if hot is None:
        return big.join(one, key)
    hot = F.broadcast(hot)
    dealt = big.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    copies = one.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return dealt.join(copies, [key, "__salt"]).drop("__salt")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(c: Column, m: int) -> Column:
    """crc32 of the value as text, modulo m; null for null."""
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(m)).cast("int")


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_chunks(column: pa.Array | pa.ChunkedArray, budget: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, offsets of the rows in them); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + budget, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def no_clash(keep: Sequence[str], added: Sequence[str]) -> None:
    """Kept columns must not be named like those that an operator adds."""
    clash = sorted(set(keep) & set(added))
    if clash:
        raise ValueError(f"keep these columns under other names: {', '.join(clash)}")


_stored: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet beside the checkpoints, and read again. It stays until `release`, as results are read from it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what `stored` has written in this process, once the results made of it are consumed; how many tables."""
    n = len(_stored)
    while _stored:
        at = spark._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return n


def positions(df: DataFrame, order: Sequence[Column], length: str, at: str, name: str) -> DataFrame:
    """df with `at`: the sum of `length` over all rows before this one in the given order, over the whole table.

    Two passes: ranges of the order are sorted and summed up each in its own task, then every range is moved by
    the sum of the ranges before it. What the driver reads is one sum for each range, so as many as there are
    shuffle partitions. The order should tell rows apart (a row's own number last), so that no value fills a range.
    """
    from pyspark import TaskContext

    schema = T.StructType([*df.schema.fields, T.StructField("__range", T.IntegerType()), T.StructField(at, T.LongType())])
    column = df.columns.index(length)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = batch.column(column).to_numpy().astype(np.int64)
            ends = total + np.cumsum(values)
            total = int(ends[-1]) if len(ends) else total
            more = [pa.array(np.full(len(values), number, np.int32)), pa.array(ends - values)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    ranges = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(summed, schema), name)
    before, rows = 0, []
    for r in sorted(ranges.groupBy("__range").agg(F.sum(length).alias("n")).collect(), key=lambda r: r["__range"]):
        rows.append((r["__range"], before))
        before += r["n"]
    moved = df.sparkSession.createDataFrame(rows, "__range int, __before long")
    return ranges.join(F.broadcast(moved), "__range").withColumn(at, F.col(at) + F.col("__before")).drop("__range", "__before")
