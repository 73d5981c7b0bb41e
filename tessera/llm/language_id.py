"""Language identification with error-correcting output codes.

Each language has a codeword; for each bit of the code a logistic classifier over hashed byte n-grams
predicts that bit. A text's language is the one whose codeword has the least loss, bits weighted by how
well their classifiers did on their lessons; a small lead over the second best flags the text as
ambiguous. The classifiers are fitted on the driver from a bounded sample: SAMPLE documents in all, spread evenly over
the languages by hash of the id, but LEAST of every language, so that however many there are each is learned. The
weights (2^SLOTS * bits numbers, bits by the logarithm of the number of languages) are broadcast.

Nulls and edge cases: a null text or one without a letter is `und` with score 0; null languages teach
nothing; with one language every text gets it, with none all are `und`; ties go to the language first in
order; rows are judged one by one, so repeated rows, ids and extra columns change nothing (a column to keep that is
named like a result is refused); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernel as K
from tessera.llm.shared import crc_mod, no_clash, table, text_chunks

#: Documents that teach, and of one language at least (or all it has).
SAMPLE, LEAST = 3_000, 4
SLOTS = 12
GRAMS = (1, 2, 3, 4)
STEPS = 80
#: Below this lead in probability a text counts as ambiguous.
LEAD = 0.2
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def counts(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, row after the last, length-normalised n-gram vectors), a few rows at a time."""
    low = K.LOWER[buf].astype(np.uint32)
    size = 1 << SLOTS
    slots = []
    with np.errstate(over="ignore"):
        key = np.zeros(len(low), np.uint32)
        for n in GRAMS:
            # the gram of n bytes that ends here
            if len(low) < n:
                break
            key = key[1:] if n > 1 else key
            key = (low[: len(low) - n + 1] if n == 1 else prev[:-1]) * np.uint32(0x01000193) + low[n - 1 :] + np.uint32(n)
            prev = key
            h = key * np.uint32(0x9E3779B1)
            slots.append((h >> np.uint32(32 - SLOTS)).astype(np.int64))
    n_rows = len(offsets) - 1
    for a in range(0, n_rows, 256):
        b = min(n_rows, a + 256)
        out = np.zeros((b - a) * size, np.float32)
        for n, s in zip(GRAMS, slots):
            # grams that begin in the row and end in it
            begin, end = offsets[a], min(offsets[b], len(s))
            if end <= begin:
                continue
            at = np.arange(begin, end)
            row = np.searchsorted(offsets[a : b + 1], at, "right") - 1
            whole = at + n <= offsets[a + 1 : b + 1][row]
            out += np.bincount((row * size + s[begin:end])[whole], minlength=len(out)).astype(np.float32)
        x = np.sqrt(out.reshape(b - a, size))
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
        yield a, b, x


def has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = K.sums_by_row(_ASCII_LETTER[buf], offsets) > 0
    for r in np.flatnonzero(~out).tolist():
        out[r] = any(c.isalpha() for c in buf[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace"))
    return out


def codebook(n: int, seed: int = 5) -> np.ndarray:
    """Codewords of +1 and -1, a row per language: all distinct splits for a few, else the widest of random books."""
    if n < 2:
        return np.ones((n, 0), np.float32)
    if n <= 5:
        k = np.arange(1, 1 << (n - 1))
        return np.stack([np.ones(len(k))] + [1.0 - 2 * (k >> i & 1) for i in range(n - 1)]).astype(np.float32)
    rng, best = np.random.default_rng(seed), None
    bits = 4 * int(np.ceil(np.log2(n))) + 8
    for _ in range(100):
        book = rng.choice([-1.0, 1.0], (n, bits)).astype(np.float32)
        gap = (bits - (book @ book.T - 2 * bits * np.eye(n))).min() / 2
        if best is None or gap > best[0]:
            best = (gap, book)
    return best[1]


class Model:
    """Languages, codebook, bit weights and the classifiers' weights."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        self.languages, self.book = languages, codebook(len(languages))
        bits = self.book.shape[1]
        self.w, self.b = np.zeros((x.shape[1] if len(x) else 1 << SLOTS, bits), np.float32), np.zeros(bits, np.float32)
        self.weight = np.ones(bits, np.float32)
        if not bits or not len(x):
            return
        target = self.book[y]
        # languages weigh the same, whatever their share of the sample
        each = (1.0 / np.bincount(y, minlength=len(languages))[y] / len(languages)).astype(np.float32)[:, None]
        m, v = [np.zeros_like(self.w), np.zeros_like(self.b)], [np.zeros_like(self.w), np.zeros_like(self.b)]
        for t in range(1, STEPS + 1):
            f = x @ self.w + self.b
            g = -target * each / (1 + np.exp(np.clip(target * f, -30, 30)))
            for k, (p, d) in enumerate(((self.w, x.T @ g), (self.b, g.sum(0)))):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                p -= (0.3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        right = (((x @ self.w + self.b) * target > 0) * each).sum(0)
        self.weight = np.maximum(2 * right - 1, 0.05).astype(np.float32)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its probability, and its lead over the next."""
        f = x @ self.w + self.b
        loss = np.stack([(self.weight * np.logaddexp(0, -code * f)).sum(1) for code in self.book], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)
        return best, top[:, -1], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)


def held_out(key: Column) -> Column:
    return F.coalesce(crc_mod(key, 4) == 2, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Classifiers from at most `sample` documents with a language that are not held out (LEAST of each language if that is more)."""
    lessons = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & (F.col("l") != "") & F.col("t").isNotNull() & ~held_out(F.col("k")))
    sizes = {r.l: r.n for r in lessons.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 1 << SLOTS), np.float32), np.zeros(0, int))
    per = max(LEAST, sample // len(languages))
    # a share of each language's rows by hash, several times what is wanted, and of these the first: no task sorts a whole language
    share = docs.sparkSession.createDataFrame([(l, min(1.0, 8 * per / sizes[l])) for l in languages], "l string, share double")
    mix = F.xxhash64(F.lit(11), "k")
    some = lessons.join(F.broadcast(share), "l").where(F.pmod(mix, F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    some = some.withColumn("__n", F.row_number().over(Window.partitionBy("l").orderBy(mix, "k"))).where(F.col("__n") <= per)
    number = {l: i for i, l in enumerate(languages)}

    def run(batches):
        for batch in batches:
            for a, b, buf, offsets in text_chunks(batch.column(1)):
                for c, d, x in counts(buf, offsets):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a + c, d - c), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["l", "x"])

    rows = [(number[r.l], bytes(r.x)) for r in some.select("l", "t").mapInArrow(run, "l string, x binary").toLocalIterator()]
    rows.sort()
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float16).astype(np.float32).reshape(len(rows), 1 << SLOTS)
    return Model(languages, x, np.array([r[0] for r in rows], int))


def identify(docs: DataFrame, model: Model, keep: Iterable[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, lang_pred, score and ambiguous, from each whole text. Map-only."""
    no_clash(keep := list(keep), ("lang_pred", "score", "ambiguous"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("ambiguous", T.BooleanType(), False)])

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            for a, b, buf, offsets in text_chunks(batch.column(len(keep))):
                letters = has_letter(buf, offsets) & bool(m.languages)
                best, score, lead = np.full(b - a, len(m.languages)), np.zeros(b - a), np.zeros(b - a)
                if m.languages:
                    for c, d, x in counts(buf, offsets):
                        best[c:d], score[c:d], lead[c:d] = m.decode(x)
                best[~letters], score[~letters], lead[~letters] = len(m.languages), 0.0, 0.0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(len(keep))] + [pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(lead < LEAD)],
                    names=[*keep, "lang_pred", "score", "ambiguous"],
                )

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
