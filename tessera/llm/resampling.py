"""Importance resampling towards a target distribution, over hashed words and word pairs.

Identical texts are collapsed by grouping the full text, so features are computed once per distinct text: once to
count the buckets (a text's counts times its number of copies), once, when the gains of all buckets are known, to
weigh it. The weights are joined back to the documents before each gets its own noise, so copies share a weight and
differ in their scores. The documents drawn are the best of one global order, found by ranges in two passes.

A bucket's gain is floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))): T features of the target, t of them in
the bucket, S and s likewise of all documents. A text's weight is the floored mean of its features' gains; the noise
(Gumbel) comes from a hash of the seed and the document's id, so a run is repeated exactly.

Nulls and edge cases: a null or empty text, or one without words, has no feature and weighs 0; a null id is hashed as
the empty string and comes last among equal scores; rows of one id have the same noise and, with one text, equal scores:
they are ordered as they come, each with a rank of its own; an empty table gives an empty result and an empty target
gains that are the smoothing's alone; other columns are not read, or carried along if they are named in `keep` (a name
of the result there is refused). Whole texts count, whatever their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel
from tessera.llm.shared import hot_keys, positions, salted_join, stored, table, text_chunks

#: Buckets of the features; per cent of the documents drawn; least words of a document that may be drawn; seed.
BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 25, 20, 7
#: Words with more bytes go through zlib one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def crc_of_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 states after each span's bytes: all spans advance together, byte by byte, the longest first."""
    state, sizes = state.copy(), ends - starts
    for i in np.flatnonzero(sizes > LONG).tolist():
        state[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    short = np.flatnonzero(sizes <= LONG)
    order = short[np.argsort(-sizes[short], kind="stable")]
    at, now, left = starts[order], state[order], sizes[order]
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j, "left"))  # spans longer than j
        now[:n] = _CRC[(now[:n] ^ buf[at[:n] + j]) & 255] ^ (now[:n] >> np.uint32(8))
    state[order] = now
    return state


def features(buf: np.ndarray, offsets: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word and every pair of neighbouring words; not in order of place."""
    buf = kernel.LOWER[buf]
    starts, ends, rows = kernel.word_spans(buf, offsets, kernel.ALNUM)
    words = crc_of_spans(buf, starts, ends, np.full(len(starts), 0xFFFFFFFF, np.uint32))
    first = np.flatnonzero(rows[1:] == rows[:-1])
    blank = _CRC[(words[first] ^ np.uint32(32)) & 255] ^ (words[first] >> np.uint32(8))
    pairs = crc_of_spans(buf, starts[first + 1], ends[first + 1], blank)
    crc = np.concatenate([words, pairs]) ^ np.uint32(0xFFFFFFFF)
    return (crc % np.uint32(n_buckets)).astype(np.int64), np.concatenate([rows, rows[first]])


def bucket_counts(texts: DataFrame, text: str, copies: str, n_buckets: int) -> np.ndarray:
    """Features in each bucket: sums by task, then one row per bucket, n_buckets of them in all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_buckets, np.int64)
        for batch in batches:
            weights = batch.column(1).to_numpy()
            for at, _, buf, offsets in text_chunks(batch.column(0)):
                buckets, rows = features(buf, offsets, n_buckets)
                np.add.at(sums, buckets, weights[at + rows])
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["bucket", "n"])

    counted = texts.select(F.col(text), F.col(copies).cast("long")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n_buckets, np.int64)
    for r in counted.collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t, n = raw.astype(float), target.astype(float), len(raw)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(texts: DataFrame, text: str, gain: np.ndarray, more: Iterable[str]) -> DataFrame:
    """more, n_features and weight of each text. Map-only."""
    more, n_buckets = list(more), len(gain)
    schema = ", ".join([f"{c} {texts.schema[c].dataType.simpleString()}" for c in more] + ["n_features long", "weight long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for at, _, buf, offsets in text_chunks(batch.column(0)):
                buckets, rows = features(buf, offsets, n_buckets)
                np.add.at(number, at + rows, 1)
                np.add.at(total, at + rows, gain[buckets])
            mean = total // np.maximum(number, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(number), pa.array(mean)], names=[*more, "n_features", "weight"])

    return texts.select(text, *more).mapInArrow(run, schema)


def resample(
    df: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, n_buckets: int = BUCKETS,
    key: str = "doc_id", text: str = "text", keep: Iterable[str] = (), target_text: str = "text",
) -> DataFrame:
    """One row per document: key, the kept columns, n_features, weight, score, and rank (null if not drawn)."""
    keep = list(keep)
    clash = {key, "n_features", "weight", "score", "rank"} & set(keep)
    if clash:
        raise ValueError(f"rename what is to be kept: {sorted(clash)}")
    body = F.coalesce(F.col(text), F.lit("")).alias("__text")
    digest = F.unhex(F.sha2(F.col("__text"), 256)).alias("__digest")
    distinct = stored(df.select(body).groupBy("__text").agg(F.count("*").alias("__copies")).select("*", digest), "resample-texts")
    wanted = bucket_counts(target.select(F.coalesce(F.col(target_text), F.lit("")).alias("__text"), F.lit(1).alias("__copies")), "__text", "__copies", n_buckets)
    gain = gains(bucket_counts(distinct, "__text", "__copies", n_buckets), wanted)
    weights = stored(weighed(distinct, "__text", gain, ["__digest", "__copies"]), "resample-weights")

    # a document's words, from its features: n words make 2n - 1 of them
    fit = F.col("n_features") >= 2 * min_words - 1
    total, eligible = weights.agg(F.sum("__copies"), F.sum(F.when(fit, F.col("__copies")))).first()
    n_drawn = percent * (eligible or 0) // 100
    hot = hot_keys(weights, "__digest", "__copies", total or 0)
    rows = df.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)], body).select("*", digest).drop("__text")
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    rows = salted_join(rows, weights.drop("__copies"), "__digest", hot, F.col("__row")).drop("__digest")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = rows.withColumn("score", F.col("weight") + noise).withColumn("__one", F.lit(1)).withColumn("__fit", fit)
    ordered = positions(rows, [F.col("__fit").desc(), F.col("score").desc(), F.col("__key").asc_nulls_last(), F.col("__row").asc()], "__one", "__at", "resample-order")
    rank = F.when(F.col("__fit") & (F.col("__at") < n_drawn), F.col("__at") + 1)
    kept = [F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)]
    return ordered.select(F.col("__key").alias(key), *kept, "n_features", "weight", "score", rank.alias("rank"))


def op12(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
