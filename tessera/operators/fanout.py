"""Fan-out of a scan into ranges of keys that hold about equally many objects.

Many objects are parted into min(16, max(2, n / 1000)) ranges at quantiles of a sample of keys (by hash, so that every
run takes the same); a sample of few different keys falls back to the keys' first path element. Ranges are half open,
the first and the last are unbounded, so together they take every key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Objects from which a scan is parted, most ranges, least, objects of a range.
PARTED_FROM, MOST, LEAST, OBJECTS = 10_000, 16, 2, 1_000
#: Keys of the sample.
SAMPLE = 20_000


def ranges(n: int, parted_from: int = PARTED_FROM) -> int:
    return 1 if n < parted_from else min(MOST, max(LEAST, n // OBJECTS))


def cut_points(df: DataFrame, key: str, parts: int, n: int, sample: int = SAMPLE) -> list[str]:
    """At most parts - 1 keys, rising. Of the keys, a sample of about `sample` is sorted on the driver, whatever n."""
    if parts < 2:
        return []
    hashed = F.pmod(F.xxhash64(key), F.lit(1 << 20))
    keys = sorted(r[0] for r in df.where(F.col(key).isNotNull() & (hashed < max(1, min(1 << 20, -(-(sample << 20) // max(n, 1)))))).select(key).collect())
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def assigned(key: Column, cuts: list[str]) -> Column:
    """The number of the range that a key lies in; a null key is in the first."""
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(key >= c, 1).otherwise(0)
    return out.cast("int")


def by_prefix(key: Column) -> Column:
    """The first element of a path."""
    return F.regexp_extract(key, "^/?([^/]*)", 1)


def fan_out(df: DataFrame, key: str, parted_from: int = PARTED_FROM) -> DataFrame:
    """df with `part` (int): its range, or, where the sample holds fewer different keys than ranges, the place of its prefix among all."""
    n = df.count()
    parts = ranges(n, parted_from)
    cuts = cut_points(df, key, parts, n)
    if len(cuts) == parts - 1 or parts == 1:
        return df.withColumn("part", assigned(F.col(key), cuts))
    prefix = F.coalesce(by_prefix(F.col(key)), F.lit(""))
    return df.withColumn("part", F.pmod(F.xxhash64(prefix), F.lit(parts)).cast("int"))
