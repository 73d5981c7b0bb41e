"""Whitening of embeddings: upper-triangle column aggregates.

Every entry becomes an integer step of 1/256. The fit list is each distinct vector once. One aggregation gives the
sums S of all dimensions; a second sums the products of centred columns for every pair of dimensions i <= j. Its
expressions are generated for a tile of TILE x TILE pairs and grouped by the tiles of the upper triangle, so that one
aggregation holds all pairs while its code stays small, whatever the number of dimensions. The driver assembles the
covariance from one row per tile (some d * d / 2 numbers) and decomposes it with LAPACK. Vectors of every row are then projected in batches. The identity error is measured on the fit list's
projected vectors, not derived.

Nulls and edge cases: a vector that is null or holds null or non-finite entries is dropped, and so is an empty one and
one whose length is not that of most rows (of equally many, the longer); repeated rows get a result each and count
once in the fit; a null id is an id like others; entries beyond a long's range are its ends; components without variance
(an eigenvalue below d times the rounding error of the largest) are not returned, so equal vectors give no row, as an
empty table does; other columns are not read. The deviation is exact as decimal(38,0).
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stored, table

#: Components returned; steps to the unit; rows of one numpy pass; dimensions along a tile's side.
COMPONENTS, STEPS, ROWS, TILE = 4, 256, 4096, 8


def integer_vectors(df: DataFrame, key: str, vector: str, steps: int = STEPS) -> DataFrame:
    """key and x (array<long>) of the rows whose vector is whole and of the length of most."""
    rows = df.select(F.col(key).alias("__key"), F.expr(f"transform({vector}, c -> cast(c as double))").alias("v"))
    # neither null nor NaN nor infinite: exists is three-valued, so nulls are looked for first
    whole = F.expr("v is not null and size(v) > 0 and not exists(v, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    rows = rows.where(F.coalesce(whole, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (sizes["d"] if sizes else 0))
    return rows.select(F.col("__key").alias(key), F.expr(f"transform(v, c -> floor({steps} * c) + 0L)").alias("x"))


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """Rows of the fit list, exact sums of its dimensions, and its covariance (divisor n)."""
    first = fit.agg(F.count("*"), *[F.sum(F.col("x")[i].cast("decimal(20,0)")) for i in range(d)]).first()
    n, sums = first[0], [int(s or 0) for s in first[1:]]
    sides, mean = range(-(-d // TILE)), [s / max(n, 1) for s in sums]
    entry = lambda i: F.col("x")[i].cast("double") - F.lit(mean[i]) if i < d else F.lit(0.0)
    centred = fit.select(F.array(*[entry(i) for i in range(TILE * len(sides))]).alias("c"))
    tiles = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in sides for j in sides if i <= j])
    tiled = centred.select("c", F.explode(tiles).alias("t"))
    side = lambda name, of: [F.expr(f"c[{TILE} * t.{of} + {k}]").alias(f"{name}{k}") for k in range(TILE)]
    tiled = tiled.select("t.i", "t.j", *side("a", "i"), *side("b", "j"))
    v = np.zeros((TILE * len(sides), TILE * len(sides)))
    for r in tiled.groupBy("i", "j").agg(*[F.expr(f"sum(a{k} * b{m})") for k in range(TILE) for m in range(TILE)]).collect():
        block = np.array(r[2:], float).reshape(TILE, TILE) / max(n, 1)
        v[TILE * r.i : TILE * r.i + TILE, TILE * r.j : TILE * r.j + TILE] = block
        v[TILE * r.j : TILE * r.j + TILE, TILE * r.i : TILE * r.i + TILE] = block.T
    return n, sums, v[:d, :d]


def decomposed(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues with variance, and their unit vectors as rows; the largest entry of each is positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1].T
    m = min(components, int((e > max(len(e) * np.finfo(float).eps * e[0], 0.0)).sum()))
    e, u = e[:m], u[:m]
    return e, u * np.sign(u[np.arange(m), np.abs(u).argmax(1)])[:, None]


def projected(df: DataFrame, n: int, sums: list[int], weights: np.ndarray) -> DataFrame:
    """df's columns but x, with y (array<double>: whitened) and deviation. Map-only."""
    from pyspark.sql import types as T

    schema = T.StructType([f for f in df.schema.fields if f.name != "x"] + [T.StructField("y", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.DecimalType(38, 0))])
    at, d = df.columns.index("x"), len(sums)
    mean = np.array([s / n for s in sums])
    squares, far = sum(s * s for s in sums), max(map(abs, sums), default=0)

    def exact(a: np.ndarray, b: np.ndarray, most: int) -> list[int]:
        """Row sums of a * b; in Python's integers where a long could overflow."""
        if most * max(int(np.abs(a.astype(float)).max(initial=0)), 1) * d >= 1 << 62:
            a, b = a.astype(object), b.astype(object)
        return (a * b).sum(1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(sums) if far < 1 << 62 else np.array(sums, object)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                x = part.column(at).flatten().to_numpy().reshape(-1, d)
                y = (x - mean) @ weights.T
                own = exact(x, x, int(np.abs(x.astype(float)).max(initial=0)))
                cross = exact(x, np.broadcast_to(s, x.shape), far)
                # sum of (n x - S)^2, in exact integers
                deviation = [Decimal(n * n * a - 2 * n * b + squares) for a, b in zip(own, cross)]
                deviation = [v if v < 10**38 else None for v in deviation]
                lists = pa.ListArray.from_arrays(np.arange(0, y.size + 1, weights.shape[0], dtype=np.int32), pa.array(y.ravel()))
                others = [part.column(i) for i in range(part.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*others, lists, pa.array(deviation, pa.decimal128(38, 0))], names=schema.names)

    return df.mapInArrow(run, schema)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, steps: int = STEPS) -> DataFrame:
    """One row per remaining row and component: key, component, n, deviation (decimal), whitened, explained, identity_error."""
    vectors = integer_vectors(df, key, vector, steps)
    fit = stored(vectors.select("x").distinct(), "whitening-fit")
    some = fit.select(F.size("x")).first()
    d = some[0] if some else 0
    empty = vectors.sparkSession.createDataFrame([], "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    nothing = vectors.select(key).limit(0).crossJoin(empty)
    if not d:
        return nothing
    n, sums, v = moments(fit, d)
    e, u = decomposed(v, components)
    m = len(e)
    if not m:
        return nothing
    weights = u / np.sqrt(e)[:, None]
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    y = projected(fit, n, sums, weights).select(*[F.col("y")[i].alias(f"y{i}") for i in range(m)])
    spread = y.agg(*[F.covar_pop(f"y{i}", f"y{j}") for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, spread))
    explained = F.array(*[F.lit(float(x / np.trace(v))) for x in e])
    out = projected(vectors, n, sums, weights).select(key, "deviation", F.posexplode("y").alias("k", "whitened"))
    return out.select(key, (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("k")].alias("explained"), F.lit(float(error)).alias("identity_error"))


def op13(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as long)"))
