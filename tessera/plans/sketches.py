"""Rollups that keep mergeable sketches: distinct counts and quantiles over any selection of partitions, without their rows.

A rollup row holds, for one partition, a HyperLogLog state of the distinct values and a KLL state of the measure.
States of partitions merge at query time, so a dashboard over a year reads a row a day. Errors: about 1.04 / sqrt(2^k)
of a distinct count (k = 12: 1.6 %), and for quantiles a rank error of about 1.7 % at KLL's default size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12
#: What the registered checks allow: three standard errors of the count; the rank of a quantile.
COUNT_ERROR, RANK_ERROR = 0.05, 0.04


def rollup(df: DataFrame, by: Sequence[str], distinct: str, measure: str) -> DataFrame:
    """by, n, distinct_state, measure_state: partial states are made before the shuffle."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, LG_K).alias("distinct_state"), F.kll_sketch_agg_bigint(F.col(measure).cast("long")).alias("measure_state"))


def merged(states: DataFrame, by: Sequence[str] = (), quantiles: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """by, n, distinct (estimate), and q<percent> of each quantile, from stored states."""
    m = states.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_state").alias("d"), F.kll_merge_agg_bigint("measure_state").alias("m"))
    return m.select(*by, "n", F.hll_sketch_estimate("d").alias("distinct"), *[F.kll_sketch_get_quantile_bigint("m", F.lit(q)).alias(f"q{round(100 * q)}") for q in quantiles])
