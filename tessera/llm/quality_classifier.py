"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on the driver from a bounded sample of labelled rows (SAMPLE, by hash of the id),
flattened into arrays and broadcast (TREES * 2^(DEPTH+1) nodes at most); every document is scored by
vectorised numpy traversal in the pass that reads its whole text.

Nulls and edge cases: a null or empty text has all statistics 0 and is scored like any; labels that
are null, of unknown ids or held out teach nothing, several labels of one id count as the largest; a
repeated document teaches once and is scored each time; without labels of both kinds the score is the
share of 1 (0.5 without any); extra columns change nothing (a column to keep that is named like a result is refused);
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernel as K
from tessera.llm.quality_rules import measure_chunk
from tessera.llm.shared import crc_mod, no_clash, table, text_chunks

#: Labelled rows that teach, at most.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 60, 4, 0.15, 64, 20, 1.0
THRESHOLD = 0.3

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "letters", "distinct", "stutter", "marks", "digits", "bangs", "pipes", "line_words", "high_bytes")


def _flags(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_MARKS, _DIGITS, _BANGS, _PIPES = _flags(".,;:?"), _flags("0123456789"), _flags("!"), _flags("|")
_HIGH = np.arange(256) >= 128


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each row of a chunk."""
    n = len(offsets) - 1
    m = measure_chunk(buf, offsets)
    starts, ends, rows = K.word_spans(buf, offsets, K.NOT_SPACE)
    hashes = K.span_hash(K.rolling(buf), starts, ends)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    fresh = ~K.later_copies(K.in_row(hashes, rows))
    words = np.maximum(m["n_words"], 1)
    chars = np.maximum(m["word_chars"], 1)
    by = lambda flags: K.sums_by_row(flags[buf], offsets)
    out = [
        np.log1p(m["n_words"]), m["word_chars"] / words, m["n_symbols"] / words, m["n_dup_lines"] / np.maximum(m["n_lines"], 1), m["n_repeat_words"] / words,
        m["n_upper"] / np.maximum(m["n_letters"], 1), m["n_letters"] / chars, np.bincount(rows[fresh], minlength=n) / words, np.bincount(rows[same], minlength=n) / words,
        by(_MARKS) / words, by(_DIGITS) / chars, by(_BANGS) / words, by(_PIPES) / words, np.log1p(m["n_words"] / np.maximum(m["n_lines"], 1)), by(_HIGH) / chars,
    ]
    return np.stack(out, 1).astype(np.float32)


class Trees:
    """A fitted ensemble as flat arrays; feature -1 marks a leaf, which leads to itself."""

    def __init__(self, base: float):
        self.base = base
        self.roots: list[int] = []
        self.feature, self.limit, self.left, self.right, self.value = [], [], [], [], []

    def add(self, feature=-1, limit=0.0, value=0.0) -> int:
        i = len(self.feature)
        for to, v in ((self.feature, feature), (self.limit, limit), (self.left, i), (self.right, i), (self.value, value)):
            to.append(v)
        return i

    def freeze(self) -> "Trees":
        self.roots = np.array(self.roots, np.int64)
        self.feature, self.left, self.right = (np.array(x, np.int64) for x in (self.feature, self.left, self.right))
        self.limit, self.value = np.array(self.limit, np.float32), np.array(self.value, np.float64)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, all trees of a row at once."""
        raw = np.full(len(x), self.base)
        if len(self.roots) and len(x):
            for a in range(0, len(x), 4096):
                part = x[a : a + 4096]
                row = np.arange(len(part))[:, None]
                node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
                for _ in range(DEPTH):
                    f = self.feature[node]
                    low = part[row, np.maximum(f, 0)] <= self.limit[node]
                    node = np.where(low, self.left[node], self.right[node])
                raw[a : a + 4096] += self.value[node].sum(1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees on histograms of gradients; logistic loss."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Trees(float(np.log(share / (1 - share)))).freeze()
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    out = Trees(float(np.log(share / (1 - share))))
    raw = np.full(len(y), out.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)

        def grow(rows: np.ndarray, depth: int) -> int:
            g, h = grad[rows], hess[rows]
            total_g, total_h = g.sum(), h.sum()
            best = (1e-6, -1, 0)
            if depth < DEPTH and len(rows) >= 2 * LEAST:
                for f, e in enumerate(edges):
                    b = binned[rows, f]
                    size = len(e) + 1
                    cg, ch = np.cumsum(np.bincount(b, g, size))[:-1], np.cumsum(np.bincount(b, h, size))[:-1]
                    cn = np.cumsum(np.bincount(b, minlength=size))[:-1]
                    gain = cg**2 / (ch + RIDGE) + (total_g - cg) ** 2 / (total_h - ch + RIDGE) - total_g**2 / (total_h + RIDGE)
                    gain[(cn < LEAST) | (len(rows) - cn < LEAST)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
            if best[1] < 0:
                v = RATE * total_g / (total_h + RIDGE)
                raw[rows] += v
                return out.add(value=v)
            _, f, k = best
            i = out.add(f, edges[f][k])
            low = binned[rows, f] <= k
            out.left[i], out.right[i] = grow(rows[low], depth + 1), grow(rows[~low], depth + 1)
            return i

        out.roots.append(grow(np.arange(len(y)), 0))
    return out.freeze()


def _map(df: DataFrame, keep: list[str], text: str, name: str, kind: T.DataType, make) -> DataFrame:
    """The kept columns and `name`, made from the statistics of each chunk of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in text_chunks(batch.column(len(keep))):
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(keep))] + [make(statistics(buf, offsets))], names=[*keep, name])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, T.StructType([df.schema[c] for c in keep] + [T.StructField(name, kind, False)]))


def held_out(key: Column) -> Column:
    return F.coalesce(crc_mod(key, 5) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text", sample: int = SAMPLE) -> Trees:
    """Trees from the labelled rows that are not held out, `sample` of them at most."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col(key)) & F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max(label).alias("__y"))
    # the sample's bound is what makes the broadcast safe
    known = known.orderBy(F.xxhash64("__k"), "__k").limit(sample)
    taught = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(known), "__k")
    got = _map(taught, ["__k", "__y"], "__t", "x", T.BinaryType(), lambda s: pa.array([r.tobytes() for r in s], pa.binary()))
    got = got.groupBy("__k").agg(F.max("__y").alias("y"), F.max("x").alias("x"))
    rows = sorted((r["__k"], r.y, bytes(r.x)) for r in got.toLocalIterator())
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([float(r[1] == 1) for r in rows]))


def classify(docs: DataFrame, model: Trees, keep: Iterable[str] = ("doc_id",), text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns, score and predicted."""
    no_clash(keep := list(keep), ("score", "predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = _map(docs, keep, text, "score", T.DoubleType(), lambda s: pa.array(shared.value.score(s)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
