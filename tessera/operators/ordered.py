"""As-of and interval joins whose work is spread by time, not by key: one key may hold all rows.

As-of: both sides are ranged by (key, time) together. Within a range every left row takes the last right row of its
key; what a range can't know is the last right row before it, one row for each range, which a second pass brings in.

Intervals: every interval lies in at most two buckets of its own length (a power of two of the width), so joins are
equalities of buckets at the longer one's level, and a long interval is not copied into many short buckets.

Sums over the overlaps need no pairs: those that begin before an interval's end, less those that end by its start. Both
are running sums over the edges of all intervals in one order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import shared_place


def _fill(key: int, is_right: int, left: int, right: int, names: list[str]):
    """Over the sorted rows of one range: left rows with the last right row of their key in it, then the range's own last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = last = None  # the range's first key, and its last so far
        held = None  # the last right row of that key, an array of one
        kinds = None
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            keys, side, rows = b.column(key), b.column(is_right).to_numpy(zero_copy_only=False), b.column(right)
            kinds = (keys.type, b.column(left).type, rows.type)
            codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            begins = np.r_[True, codes[1:] != codes[:-1]]
            goes_on = last is not None and keys[0].as_py() == last
            if first is None:
                first = keys[0].as_py()
            at = np.arange(n)
            group = np.maximum.accumulate(np.where(begins, at, 0))
            seen = np.maximum.accumulate(np.where(side, at, -1))
            match = np.where(seen >= group, seen, -1)
            carried = (group == 0) & (match < 0) & goes_on & (held is not None)
            # index 0 of the pool is the row held from the batch before, or null
            pool = pa.concat_arrays([held if held is not None else pa.nulls(1, rows.type), rows])
            take = np.where(carried, 0, match + 1)
            known = carried | (match >= 0)
            wanted = np.flatnonzero(~side)
            if len(wanted):
                index = pa.array(take[wanted], mask=~known[wanted])
                open_ = ~known & (codes == codes[0]) if first == keys[0].as_py() else np.zeros(n, bool)
                yield pa.RecordBatch.from_arrays(
                    [b.column(left).take(pa.array(wanted)), pool.take(index), keys.take(pa.array(wanted)), pa.array(open_[wanted]), pa.array(np.full(len(wanted), part, np.int32)), pa.array(np.zeros(len(wanted), bool))], names=names)
            end = n - 1
            if match[end] >= 0:
                held = rows.slice(int(match[end]), 1)
            elif not carried[end]:
                held = None
            last = keys[end].as_py()
        if first is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kinds[1]), held if held is not None else pa.nulls(1, kinds[2]), pa.array([last], kinds[0]), pa.array([False]), pa.array([part], pa.int32()), pa.array([True])], names=names)

    return run


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, tie: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """left with `right`: the struct of the last right row of the same key, earlier (strict) or no later than the left one.

    Of right rows of one time the last by `tie` counts. Rows without a key or a time match nothing.
    """
    whole = lambda df: F.struct(*df.columns)
    l_type, r_type = left.select(whole(left).alias("x")).schema["x"].dataType, right.select(whole(right).alias("x")).schema["x"].dataType
    ties = [F.col(c) for c in tie]
    none = lambda t: F.lit(None).cast(t)
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    usable = F.col(by).isNotNull() & F.col(time).isNotNull()
    a = left.where(usable).select(key(by).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.lit(False).alias("is_right"), whole(left).alias("l"), none(r_type).alias("r"), *[none(right.schema[c].dataType).alias(f"tie{i}") for i, c in enumerate(tie)])
    b = right.where(usable).select(key(by).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.lit(True).alias("is_right"), none(l_type).alias("l"), whole(right).alias("r"), *[c.alias(f"tie{i}") for i, c in enumerate(ties)])
    # at one time a left row stands before the right ones if they must be earlier, else behind them
    order = ["k", "t", F.col("is_right") if strict else ~F.col("is_right"), *[f"tie{i}" for i in range(len(tie))]]
    names = ["l", "r", "k", "open", "part", "tail"]
    schema = T.StructType([T.StructField("l", l_type), T.StructField("r", r_type), T.StructField("k", T.StringType()), T.StructField("open", T.BooleanType()), T.StructField("part", T.IntegerType()), T.StructField("tail", T.BooleanType())])
    ranged = a.unionByName(b).repartitionByRange(*order).sortWithinPartitions(*order).select("k", "is_right", "l", "r")
    spark, at = left.sparkSession, shared_place(left.sparkSession, "asof")
    ranged.mapInArrow(_fill(0, 1, 2, 3, names), schema).write.parquet(at)
    filled = spark.read.schema(schema).parquet(at)
    # one row for each range: the right row that each would hand on
    carry, brought = (None, None), []
    for r in sorted(filled.where("tail").select("part", "k", "r").collect(), key=lambda r: r.part):
        if carry[1] is not None:
            brought.append((r.part, carry[0], carry[1]))
        carry = (r.k, r.r) if r.r is not None or r.k != carry[0] else carry
    into = spark.createDataFrame(brought, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("before", r_type)]))
    joined = filled.where("not tail").join(F.broadcast(into), "part", "left")
    found = F.when(F.col("open") & (F.col("key") == F.col("k")), F.col("before")).otherwise(F.col("r"))
    out = joined.select("l.*", found.alias("right"))
    return out.unionByName(left.where(~F.coalesce(usable, F.lit(False))).withColumn("right", none(r_type)))


def interval_join(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], width: float, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows (structs a and b) whose half-open intervals overlap, of equal `by` columns if given. Empty intervals overlap nothing."""
    def cells(df: DataFrame, name: str, span: tuple[str, str], levels: list[int]) -> DataFrame:
        start, end = (F.col(c).cast("double") for c in span)
        level = F.greatest(F.lit(0), F.ceil(F.log2((end - start) / F.lit(float(width))))).cast("int")
        rows = df.where(end > start).select(*[F.col(c).alias(f"by{i}") for i, c in enumerate(by)], F.struct(*df.columns).alias(name), start.alias(f"{name}_s"), end.alias(f"{name}_e"), level.alias(f"{name}_l"))
        rows = rows.withColumn("level", F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col(f"{name}_l"))))
        size = F.lit(float(width)) * F.pow(F.lit(2.0), "level")
        first, last = F.floor(F.col(f"{name}_s") / size), F.ceil(F.col(f"{name}_e") / size) - 1
        return rows.withColumn("cell", F.explode(F.sequence(first, F.greatest(first, last))))

    def present(df: DataFrame, span: tuple[str, str]) -> set[int]:
        """The levels of a side: at most one for each power of two."""
        start, end = (F.col(c).cast("double") for c in span)
        found = df.where(end > start).select(F.greatest(F.lit(0), F.ceil(F.log2((end - start) / F.lit(float(width))))).cast("int").alias("x")).distinct().collect()
        return {r.x for r in found}

    levels = sorted(present(a, a_span) | present(b, b_span))
    if not levels:
        levels = [0]
    on = ["level", "cell", *[f"by{i}" for i in range(len(by))]]
    pairs = cells(a, "a", a_span, levels).join(cells(b, "b", b_span, levels), on)
    size = F.lit(float(width)) * F.pow(F.lit(2.0), "level")
    # at the longer one's level, in the cell where the overlap begins: each pair once
    once = (F.col("level") == F.greatest("a_l", "b_l")) & (F.col("cell") == F.floor(F.greatest("a_s", "b_s") / size))
    return pairs.where(once & (F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e"))).select("a", "b")


def _running(names: list[str]):
    """Over the sorted edges of one range (group, side, count, weight): sums of the starts (or ends) before each asking edge, then the range's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        total, group = np.zeros(4, np.int64), None  # starts and their weights, ends and theirs
        for b in batches:
            group = b.column(0).type
            side, weight = b.column(1).to_numpy(), b.column(2).to_numpy()
            of = [(side == START), np.where(side == START, weight, 0), (side == END), np.where(side == END, weight, 0)]
            sums = [np.cumsum(x, dtype=np.int64) + t for x, t in zip(of, total)]
            before, after = np.flatnonzero(side == ASKS_STARTS), np.flatnonzero(side == ASKS_ENDS)
            asks = np.r_[before, after]
            if len(asks):
                n, w = (np.r_[sums[i][before], -sums[i + 2][after]] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(asks)), pa.array(side[asks]), pa.array(n), pa.array(w), pa.array(np.full(len(asks), part, np.int32)), pa.nulls(len(asks), pa.list_(pa.int64()))], names=names)
            total = np.array([x[-1] for x in sums], np.int64) if b.num_rows else total
        if group is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, group), pa.array([START], pa.int32()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([part], pa.int32()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=names)

    return run


#: The sides of edges, in the order in which they stand at one place: what starts where an interval ends, or ends where it starts, does not overlap it.
ASKS_STARTS, START, END, ASKS_ENDS = 0, 1, 2, 3


def overlap_sums(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], group: Sequence[str], weight: str) -> DataFrame:
    """group, n, total: for each group of rows of a, the pairs with a row of b that a_start < b_end and b_start < a_end hold for, and their sum of `weight`.

    Groups without a pair are left out, and so are empty intervals of b; those of a overlap what they lie inside. NaN
    is the greatest number, as in SQL. Weights are whole numbers without nulls whose sum over b fits a long. No pair is made
    but of rows of a that end before they start.
    """
    a_start, a_end, b_start, b_end = (F.col(c).cast("double") + F.lit(0.0) for c in (*a_span, *b_span))  # one zero
    key, far = F.struct(*group), F.lit(float("inf"))
    forward, backward, real = a.where(a_start <= a_end), a.where((a_start > a_end) & (a_start < far) & (a_end > -far)), b.where(b_start < b_end)
    kind = a.select(key.alias("g")).schema["g"].dataType
    asks = forward.select(key.alias("g"), F.explode(F.array(F.struct(F.lit(ASKS_STARTS).alias("side"), a_end.alias("x")), F.struct(F.lit(ASKS_ENDS).alias("side"), a_start.alias("x")))).alias("e"), F.lit(0).cast("long").alias("w"))
    edges = real.select(F.lit(None).cast(kind).alias("g"), F.explode(F.array(F.struct(F.lit(START).alias("side"), b_start.alias("x")), F.struct(F.lit(END).alias("side"), b_end.alias("x")))).alias("e"), F.col(weight).cast("long").alias("w"))
    # the last column deals out edges of one place
    ordered = asks.unionByName(edges).select("g", "e.side", "w", "e.x", F.xxhash64("g", "w").alias("h"))
    ordered = ordered.repartitionByRange("x", "side", "h").sortWithinPartitions("x", "side").select("g", "side", "w")
    schema = T.StructType([T.StructField("g", kind), T.StructField("side", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    spark, at = a.sparkSession, shared_place(a.sparkSession, "overlaps")
    ordered.mapInArrow(_running([f.name for f in schema]), schema).write.parquet(at)
    found = spark.read.schema(schema).parquet(at)
    # one row for each range: what stands before it
    before, sums = [], [0, 0, 0, 0]
    for r in sorted(found.where("sums is not null").select("part", "sums").collect(), key=lambda r: r.part):
        before.append((r.part, *sums))
        sums = [x + y for x, y in zip(sums, r.sums)]
    into = spark.createDataFrame(before, "part int, starts long, start_total long, ends long, end_total long")
    asked = found.where("sums is null").join(F.broadcast(into), "part")
    first = F.col("side") == ASKS_STARTS
    parts = asked.select("g", (F.col("n") + F.when(first, F.col("starts")).otherwise(-F.col("ends"))).alias("n"), (F.col("total") + F.when(first, F.col("start_total")).otherwise(-F.col("end_total"))).alias("total"))
    low, high = backward.agg(F.min(a_end), F.max(a_start)).first()
    if low is not None:
        # those that hold the whole way back; only for the join, b is cut off where no such row lies
        cut = real.select("*", F.greatest(b_start, F.lit(low - abs(low) - 1)).alias("cut_start"), F.least(b_end, F.lit(high + abs(high) + 1)).alias("cut_end")).where("cut_start < cut_end")
        pairs = interval_join(backward, cut, a_span[::-1], ("cut_start", "cut_end"), 16.0)
        inside = (F.col(f"a.{a_span[0]}") < F.col(f"b.{b_span[1]}")) & (F.col(f"b.{b_span[0]}") < F.col(f"a.{a_span[1]}"))
        parts = parts.unionByName(pairs.where(inside).select(F.struct(*[F.col(f"a.{c}").alias(c) for c in group]).alias("g"), F.lit(1).cast("long").alias("n"), F.col(f"b.{weight}").cast("long").alias("total")))
    return parts.groupBy("g").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0").select("g.*", "n", "total")
