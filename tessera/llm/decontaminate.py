"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items are cut into windows (13 consecutive words; a shorter item is one window), and windows
into shingles of up to 3 words. All documents are counted to order the shingles by rarity. As a document
must hold every shingle of a window to contain it, one shingle suffices as the prefix that has to match:
the rarest. Where it stands in a document, its position in the window fixes where the window would begin
(positional bound) and end (length bound); only there the window is verified, first by the hashes of its
words and then by the words themselves.

The benchmark is read in blocks of at most BLOCK_WORDS words, so what is broadcast at once has that
bound at every benchmark size; each block is one pass over the documents, and the passes' hits are
joined. Documents are never shuffled for a single block.

Nulls and edge cases: null or wordless documents have no words and no hits; null or wordless items have
no windows; items with equal texts or ids each count by their distinct id, one with a null id counts in n_hit
and contaminated only, not in n_items and the digest; repeated document rows are
judged one by one (with several blocks they are told apart by a row id); extra columns change nothing;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernel as K
from tessera.llm.shared import cut, table, text_chunks

WINDOW = 13
SHINGLE = 3
#: Words of benchmark text in a block; about 100 bytes each when broadcast.
BLOCK_WORDS = 200_000


def hashed_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and starts, ends, rows and hashes of their words."""
    buf = K.LOWER[buf]
    starts, ends, rows = K.word_spans(buf, offsets, K.ALNUM)
    return buf, starts, ends, rows, K.span_hash(K.rolling(buf), starts, ends)


class Block:
    """The windows of some items: their words, and for each shingle length the shingles."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.ids: list[str | None] = []
        seen: dict[tuple[bytes, ...], int] = {}
        self.windows: list[tuple[bytes, ...]] = []
        self.items: list[set[int]] = []
        texts = pa.array([t for _, t in items], pa.large_string())
        number: dict[str | None, int] = {}
        for a, _, buf, offsets in text_chunks(texts):
            buf, starts, ends, rows, _ = hashed_words(buf, offsets)
            raw = buf.tobytes()
            words = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
            bounds = np.searchsorted(rows, np.arange(len(offsets)))
            for r in range(len(offsets) - 1):
                own = words[bounds[r] : bounds[r + 1]]
                if not own:
                    continue
                item = number.setdefault(items[a + r][0], len(number))
                for k in range(max(1, len(own) - window + 1)):
                    w = tuple(own[k : k + window])
                    i = seen.setdefault(w, len(seen))
                    if i == len(self.windows):
                        self.windows.append(w)
                        self.items.append(set())
                    self.items[i].add(item)
        self.ids = list(number)
        # hashes of the windows' words, and their shingles by length
        flat = b" ".join(b" ".join(w) for w in self.windows)
        buf = np.frombuffer(flat, np.uint8)
        _, _, _, _, hashes = hashed_words(buf, np.array([0, len(buf)]))
        self.sizes = np.array([len(w) for w in self.windows], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.hashes = hashes
        of_word = np.repeat(np.arange(len(self.windows)), self.sizes)
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # length -> hash, window, offset
        for n in range(1, SHINGLE + 1):
            g, first = K.runs(hashes, of_word, n)
            fits = np.minimum(self.sizes[of_word[first]], SHINGLE) == n
            if fits.any():
                g, first = g[fits], first[fits]
                self.shingles[n] = (g, of_word[first], first - self.begin[of_word[first]])
        self.known = {n: np.unique(s[0]) for n, s in self.shingles.items()}
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Choose each window's rarest shingle; ties by hash."""
        for n, (g, window, at) in self.shingles.items():
            keys = self.known[n]
            rarity = np.array([counts.get((n, int(k.astype(np.int64))), 0) for k in keys], np.int64)[np.searchsorted(keys, g)]
            pick = np.lexsort((at, g, rarity, window))
            pick = pick[np.concatenate([[True], np.diff(window[pick]) > 0])]
            pick = pick[np.argsort(g[pick], kind="stable")]
            self.prefix[n] = (g[pick], window[pick], at[pick])

    def count(self, rows: np.ndarray, hashes: np.ndarray) -> dict[int, np.ndarray]:
        """How often each known shingle occurs, by length."""
        out = {}
        for n, keys in self.known.items():
            g, _ = K.runs(hashes, rows, n)
            out[n] = np.bincount(found(keys, g)[1], minlength=len(keys))
        return out

    def hits(self, buf, starts, ends, rows, hashes) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of each verified occurrence in a chunk."""
        word, window = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (keys, wins, at) in self.prefix.items():
            g, first = K.runs(hashes, rows, n)
            lo, hi = np.searchsorted(keys, g), np.searchsorted(keys, g, "right")
            times = hi - lo
            some = np.flatnonzero(times)
            if not len(some):
                continue
            i = np.repeat(lo[some], times[some]) + np.arange(times[some].sum()) - np.repeat(np.cumsum(times[some]) - times[some], times[some])
            begin = np.repeat(first[some], times[some]) - at[i]
            w = wins[i]
            size = self.sizes[w]
            end = begin + size
            ok = (begin >= 0) & (end <= len(rows))
            begin, w, size, end = begin[ok], w[ok], size[ok], end[ok]
            ok = rows[begin] == rows[end - 1]
            begin, w, size = begin[ok], w[ok], size[ok]
            for j in range(WINDOW if not len(size) else int(size.max())):
                if not len(begin):
                    break
                use = j < size
                same = np.ones(len(begin), bool)
                same[use] = hashes[begin[use] + j] == self.hashes[self.begin[w[use]] + j]
                begin, w, size = begin[same], w[same], size[same]
            word.append(begin)
            window.append(w)
        word, window = np.concatenate(word), np.concatenate(window)
        raw = memoryview(buf)
        exact = [all(raw[starts[b + j] : ends[b + j]] == x for j, x in enumerate(self.windows[w])) for b, w in zip(word.tolist(), window.tolist())]
        exact = np.array(exact, bool) if exact else np.zeros(0, bool)
        return word[exact], window[exact]


def found(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted keys, and the keys' places."""
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    is_in = keys[at] == values
    return is_in, at[is_in]


def blocks(benchmark: DataFrame, item: str, text: str, words: int, window: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks; a block ends when it has `words` words (an item's text is never cut)."""
    held, n = [], 0
    for r in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        held.append((r.i, r.t))
        n += len(r.t) // 4 + 1
        if n >= words:
            yield held
            held, n = [], 0
    if held:
        yield held


def _counts(docs: DataFrame, text: str, shared) -> dict[tuple[int, int], int]:
    """Occurrences of the block's shingles over all documents."""

    def run(batches):
        block = pickle.loads(shared.value)
        total = {n: np.zeros(len(k), np.int64) for n, k in block.known.items()}
        for batch in batches:
            for _, _, buf, offsets in text_chunks(batch.column(0)):
                _, _, _, rows, hashes = hashed_words(buf, offsets)
                for n, c in block.count(rows, hashes).items():
                    total[n] += c
        for n, c in total.items():
            seen = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), n), pa.int32()), pa.array(block.known[n][seen].astype(np.int64)), pa.array(c[seen])], names=["n", "g", "c"])

    # each task sends a row per shingle of the block at most, and so does the sum
    per = docs.select(F.col(text).alias("t")).mapInArrow(run, "n int, g long, c long")
    return {(r.n, r.g): r.c for r in per.groupBy("n", "g").agg(F.sum("c").alias("c")).toLocalIterator()}


def _merged(begin: np.ndarray, end: np.ndarray) -> int:
    """Words that the intervals cover."""
    order = np.argsort(begin)
    total, reach = 0, -1
    for b, e in zip(begin[order].tolist(), end[order].tolist()):
        if e > reach:
            total += e - max(b, reach)
            reach = e
    return total


def matches(docs: DataFrame, benchmark: DataFrame, keep: Iterable[str] = ("doc_id",), text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The kept columns and n_words, n_hit, n_items, items_sha256, contaminated."""
    keep = list(keep)
    spark = docs.sparkSession
    digest = [T.StructField("n_words", T.LongType(), False), T.StructField("n_hit", T.LongType(), False), T.StructField("n_items", T.LongType(), False), T.StructField("items_sha256", T.StringType(), False)]
    raw = [digest[0], T.StructField("spans", T.ArrayType(T.LongType()), False), T.StructField("items", T.ArrayType(T.StringType()), False)]

    def one(df, kept, shared, final):
        """A pass of one block; final: digests at once, else spans (begin, end, begin, ...) and items."""

        def run(batches):
            block = pickle.loads(shared.value)
            for batch in batches:
                for a, b, buf, offsets in text_chunks(batch.column(len(kept))):
                    n = b - a
                    buf, starts, ends, rows, hashes = hashed_words(buf, offsets)
                    word, win = block.hits(buf, starts, ends, rows, hashes)
                    row = rows[word] if len(word) else np.zeros(0, np.int64)
                    by_row = np.argsort(row, kind="stable")
                    word, win, row = word[by_row], win[by_row], row[by_row]
                    edges = np.searchsorted(row, np.arange(n + 1))
                    first = np.searchsorted(rows, np.arange(n))
                    spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
                    n_hit = np.zeros(n, np.int64)
                    for r in np.unique(row).tolist():
                        s = slice(edges[r], edges[r + 1])
                        got = sorted({x for w in set(win[s].tolist()) for i in block.items[w] if (x := block.ids[i]) is not None})
                        items[r] = got
                        begin, end = word[s], word[s] + block.sizes[win[s]]
                        if final:
                            n_hit[r] = _merged(begin, end)
                        else:
                            spans[r] = np.stack([begin - first[r], end - first[r]], 1).ravel().tolist()
                    columns = [batch.column(i).slice(a, n) for i in range(len(kept))] + [pa.array(np.bincount(rows, minlength=n).astype(np.int64))]
                    if final:
                        columns += [pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items])]
                    else:
                        columns += [pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept, *[f.name for f in (digest if final else raw)]])

        schema = T.StructType([df.schema[c] for c in kept] + (digest if final else raw))
        return df.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)

    def ready(items):
        block = Block(items, window)
        shared = spark.sparkContext.broadcast(pickle.dumps(block))
        block.order(_counts(docs, text, shared))
        return spark.sparkContext.broadcast(pickle.dumps(block))

    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    stream = blocks(benchmark, item, item_text, block_words, window)
    first = next(stream, [])
    second = next(stream, None)
    if second is None:
        return one(docs, keep, ready(first), True).withColumn("contaminated", contaminated)
    # several blocks: the rows get ids that last, and the blocks' hits meet by them
    rowed = cut(docs.select(*keep, F.col(text).alias("__t")).withColumn("__row", F.monotonically_increasing_id()))
    rowed = rowed.withColumnRenamed("__t", text) if text not in keep else rowed.drop("__t")
    parts = None
    for items in _chain(first, second, stream):
        got = cut(one(rowed, ["__row"], ready(items), False).where(F.size("spans") > 0))
        parts = got if parts is None else parts.unionByName(got)
    hit = parts.groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.udf(lambda s: _merged(np.array(s[::2]), np.array(s[1::2])), "long")
    hit = hit.select("__row", covered("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    counted = one(rowed, [*keep, "__row"], spark.sparkContext.broadcast(pickle.dumps(Block([]))), True).select(*keep, "__row", "n_words")
    out = counted.join(hit, "__row", "left").fillna(0, ["n_hit", "n_items"]).fillna(hashlib.sha256(b"").hexdigest(), ["items_sha256"])
    return out.select(*keep, "n_words", "n_hit", "n_items", "items_sha256").withColumn("contaminated", contaminated)


def _chain(first, second, rest):
    yield first
    yield second
    yield from rest


def filter_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Rows that are not contaminated, with all their columns, whatever these are named."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(text).alias("__words"))
    return matches(rows, benchmark, ["__doc"], "__words").where(~F.col("contaminated")).select("__doc.*")


def op3(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
