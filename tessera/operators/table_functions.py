"""Table functions for SQL, registered by name.

`tessera_chunks(TABLE(SELECT doc_id, text ...) PARTITION BY doc_id)`: the chunks of whole texts, in Arrow batches.
`tessera_spans(TABLE(SELECT doc_id, text ...) PARTITION BY doc_id)`: the detected spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import detect

NAMES = ("tessera_chunks", "tessera_spans")


def _texts(batch: pa.RecordBatch) -> list[tuple[int, str]]:
    return [(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if t]


@F.arrow_udtf(returnType="doc_id bigint, chunk int, start int, end int, text string")
class Chunks:
    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = [(i, k, *c) for i, t in _texts(batch) for k, c in enumerate(detect.chunks(t))]
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        yield pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "chunk", "start", "end", "text"), columns, kinds)})


@F.arrow_udtf(returnType="doc_id bigint, entity_type string, start int, end int, value string, confidence double")
class Spans:
    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = [(i, s.entity_type, s.start, s.end, s.text, float(s.confidence)) for i, t in _texts(batch) for s in detect.detect_text(t)]
        columns = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64())
        yield pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "entity_type", "start", "end", "value", "confidence"), columns, kinds)})


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    spark.udtf.register("tessera_chunks", Chunks)
    spark.udtf.register("tessera_spans", Spans)
