"""Mixture-controlled packing of documents into windows by deficit round-robin over source queues.

Every source is a queue of documents in a seeded order. In each round a queue earns its credit, the share of a
window that its target proportion gives it, and sends the packets (at most `packet` tokens of one document) that
its credit covers; what it could not yet spend is its deficit, below one packet, and is carried on. A packet that
ends at token e of its queue is therefore sent in round ceil(e / credit), wherever it stands, so rounds are computed
from positions in the queues and partitions need no state of each other but their starting positions. The packets of
all rounds form one sequence, cut every `window` tokens: deficits run on across windows and across partitions.
A queue that has run dry loses its turn, and later windows take more rounds of the others. Packets of a document
that are sent in one round stay together as one piece.

Targets are weights by source; a source without one weighs its share of all tokens. Without targets the mixture of
the whole corpus fills every window, and all queues run dry together. What is left at the end is cut into
sequences whose lengths are powers of two, so nothing is padded.

A document is encoded once; ids are written to the shared folder (two bytes each where the vocabulary allows it),
positions are found on lengths alone, and the ids are cut once their cuts are known.

Nulls and edge cases: a null or empty text is the end token alone; a null source is a queue of its own; null ids and
repeated rows are documents like others (a row's own number tells them apart); an empty table gives no piece; other
columns are not read. Texts are never cut for encoding; a document longer than a window goes on in later ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bpe import byte_letters
from tessera.llm.shared import hot_keys, positions, salted_join, stored, table

#: Tokens of a window; tokens of a packet, so the most that a queue is behind or ahead; the token after each document.
WINDOW, PACKET, END = 2048, 64, 1
#: Fixed value: how byte-level vocabularies of this kind part a text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_encoders: dict = {}


def encoder(path: str):
    """The encoder of a byte-level BPE file whose ids are in the order of its merges."""
    if path not in _encoders:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], {c: b for b, c in enumerate(byte_letters())}
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without normalizer is needed")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in s): i for s, i in model["vocab"].items() if s not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("the ids must be in the order of the merges")
        _encoders[path] = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def id_type(path: str | None, end: int) -> str:
    """The narrowest type for ids in storage."""
    return "<u2" if max(encoder(path or default_path()).max_token_value, end) < 1 << 16 else "<u4"


def encoded(df: DataFrame, key: str, source: str, text: str, path: str | None, end: int, kind: str) -> DataFrame:
    """__row, key, source, __n and __ids (of type `kind`) of every document, written once."""
    schema = T.StructType([T.StructField("__key", df.schema[key].dataType), T.StructField("__source", T.StringType()), T.StructField("__n", T.LongType()), T.StructField("__ids", T.BinaryType())])
    last, width = np.array([end], kind).tobytes(), np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path or default_path())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [coder.encode_to_numpy(t, allowed_special="all").astype(kind).tobytes() + last if t else last for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(i) // width for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    docs = df.select(F.col(key).alias("__key"), F.col(source).cast("string").alias("__source"), F.col(text).alias("__text"))
    return stored(docs.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()), "packing-ids")


def cut_ids(docs: DataFrame, kind: str) -> DataFrame:
    """One row per piece of (__key, __source, __n, __ids, pieces): its columns and its ids, 4 bytes each."""
    names = ("start", "length", "sequence_id", "offset")
    schema = T.StructType([docs.schema[c] for c in ("__key", "__source", "__n")] + [T.StructField(c, T.LongType()) for c in names] + [T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                lists = part.column(4)
                flat, ends = lists.flatten(), lists.offsets.to_numpy()
                ends = ends - ends[0]
                rows = np.repeat(np.arange(part.num_rows), np.diff(ends))
                start, length = (flat.field(c).to_numpy() for c in ("start", "length"))
                wide = [np.frombuffer(b, kind).astype("<u4").tobytes() for b in part.column(3).to_pylist()]
                ids = [wide[r][4 * a : 4 * (a + n)] for r, a, n in zip(rows.tolist(), start.tolist(), length.tolist())]
                columns = [part.column(i).take(pa.array(rows)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, *[flat.field(c) for c in names], pa.array(ids, pa.binary())], names=schema.names)

    return docs.select("__key", "__source", "__n", "__ids", "pieces").mapInArrow(run, schema)


def credits(queues: DataFrame, total: int, targets: Mapping[str, float] | None, window: int) -> DataFrame:
    """queues with __credit: tokens that each earns in a round."""
    weight = F.col("__tokens") / F.lit(float(max(total, 1)))
    for name, w in (targets or {}).items():
        if not w > 0:
            raise ValueError(f"the target of {name} must be above 0")
        weight = F.when(F.col("__queue") == f"={name}", F.lit(float(w))).otherwise(weight)
    queues = queues.withColumn("__weight", weight)
    weights = queues.agg(F.sum("__weight")).first()[0] or 1.0
    return queues.withColumn("__credit", F.lit(window / weights) * F.col("__weight")).drop("__weight")


def pack(
    df: DataFrame, targets: Mapping[str, float] | None = None, window: int = WINDOW, packet: int = PACKET, path: str | None = None,
    key: str = "doc_id", source: str = "source", text: str = "text", end: int = END, seed: int = 17,
) -> DataFrame:
    """One row per piece: key, source, start, length, ids (binary, 4 bytes each), doc_tokens, sequence_id, offset.

    path: of the vocabulary's file, the same on every executor; None: the public 50k byte vocabulary.
    """
    kind = id_type(path, end)
    docs = encoded(df, key, source, text, path, end, kind)
    lengths = docs.select("__row", "__n", F.coalesce(F.concat(F.lit("="), "__source"), F.lit("")).alias("__queue"), F.xxhash64(F.lit(seed), F.col("__key").cast("string")).alias("__mix"))
    lengths = positions(lengths, [F.col("__queue"), F.col("__mix"), F.col("__row")], "__n", "__at", "packing-queues").drop("__mix")
    counted = stored(lengths.groupBy("__queue").agg(F.min("__at").alias("__begin"), F.sum("__n").alias("__tokens"), F.count("*").alias("__docs")), "packing-sources")
    rows, total = counted.agg(F.sum("__docs"), F.sum("__tokens")).first()
    rows, total = rows or 0, total or 0
    hot = hot_keys(counted, "__queue", "__docs", rows)
    queued = salted_join(lengths, credits(counted, total, targets, window).drop("__docs", "__tokens"), "__queue", hot, F.col("__row"))

    # the last packet that a document sends in each round ends a piece
    begin = "(__at - __begin)"
    queued = queued.withColumn("packets", F.expr(
        f"transform(sequence(1L, ceil(__n / {packet})), i -> named_struct('round', ceil(({begin} + least(i * {packet}, __n)) / __credit), 'stop', least(i * {packet}, __n)))"))
    queued = queued.withColumn("packets", F.expr("filter(packets, (p, i) -> i = size(packets) - 1 or packets[i + 1].round > p.round)"))
    ends = queued.select("__row", "__queue", F.expr(begin).alias("__in_queue"), F.col("packets.round").alias("round"), F.col("packets.stop").alias("stop"))
    ends = ends.withColumn("start", F.expr("concat(array(0L), slice(stop, 1, size(stop) - 1))"))
    pieces = ends.select("__row", "__queue", "__in_queue", F.inline(F.arrays_zip("round", "start", "stop")))
    pieces = pieces.select("__row", "__queue", "round", (F.col("__in_queue") + F.col("start")).alias("__in_queue"), "start", (F.col("stop") - F.col("start")).alias("length"))
    pieces = positions(pieces, [F.col("round"), F.col("__queue"), F.col("__in_queue")], "length", "__at", "packing-rounds")

    # whole windows, then powers of two
    whole, tail = total // window * window, []
    left = total - whole
    for power in reversed(range(left.bit_length())):
        if left >> power & 1:
            tail.append((tail[-1] if tail else whole) + (1 << power))
    bounds = f"array({', '.join(f'{b}L' for b in tail[:-1])})" if tail[:-1] else "cast(array() as array<bigint>)"
    first, last = f"__at div {window} + 1", f"(__at + length - 1) div {window}"
    pieces = pieces.withColumn("cuts", F.expr(
        f"concat(if({last} >= {first}, transform(sequence({first}, greatest({last}, {first})), w -> w * {window}), cast(array() as array<bigint>)),"
        f" filter({bounds}, b -> b > __at and b < __at + length))"))
    pieces = pieces.select("__row", "start", "__at", F.expr("concat(array(__at), cuts)").alias("a"), F.expr("concat(cuts, array(__at + length))").alias("b"))
    pieces = pieces.select("__row", "start", "__at", F.inline(F.arrays_zip("a", "b")))
    place = F.expr(
        f"named_struct('start', start + a - __at, 'length', b - a, 'sequence_id', a div {window} + size(filter({bounds}, x -> x <= a)),"
        f" 'offset', a - greatest(a div {window} * {window}, coalesce(array_max(filter({bounds}, x -> x <= a)), 0L)))")
    # a document's pieces are as many as its length allows
    placed = pieces.select("__row", place.alias("p")).groupBy("__row").agg(F.collect_list("p").alias("pieces"))
    out = cut_ids(docs.join(placed, "__row"), kind)
    return out.select(F.col("__key").alias(key), F.col("__source").alias(source), "start", "length", "ids", F.col("__n").alias("doc_tokens"), "sequence_id", "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence of `pack`: sequence_id, n_tokens, ids (binary), and the documents' starts in it."""
    grouped = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    joined = F.expr("aggregate(p, cast('' as binary), (s, x) -> concat(s, x.ids))")
    return grouped.select("sequence_id", F.expr("aggregate(p, 0L, (s, x) -> s + x.length)").alias("n_tokens"), joined.alias("ids"), F.expr("p.offset").alias("starts"))


def op11(spark, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
