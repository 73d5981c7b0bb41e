"""Committed export sinks: `format("tessera_sink")` writes lines so that a retried task, batch or run leaves no line twice.

Every task writes files of its own, under a name that no other attempt has; the commit of a batch names those of the
attempts that succeeded in one manifest, made visible by one rename. What no manifest names was never sent. A batch
has an identity (`batch` for a batch write, the stream's batch number else): one that is committed already is given up
when it is written again. The manifest also holds the sink's cursor, the greatest value of the `cursor` column that
it has sent, so that lines and cursor can't disagree.

Options: path (on a filesystem that driver and executors mount), sink (a name below it), batch. Columns: line, and
optionally cursor (string, in an order that strings keep, such as ISO times).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from tessera.sources.files import local

#: Lines of one file: a task starts another one beyond it.
LINES = 100_000


@dataclass
class Sent(WriterCommitMessage):
    files: list[str]
    lines: int
    cursor: str | None


def _place(options: dict[str, str]) -> str:
    sink = options["sink"]
    if not sink or "/" in sink or sink.startswith("."):
        raise ValueError(f"{sink!r} is no name of a sink")
    return os.path.join(local(options["path"]), sink)


def manifests(at: str) -> list[dict]:
    """The committed batches of a sink, in the order of their commits."""
    where = os.path.join(at, "_committed")
    if not os.path.isdir(where):
        return []
    found = []
    for name in os.listdir(where):
        if name.endswith(".json"):
            with open(os.path.join(where, name), encoding="utf-8") as f:
                found.append(json.load(f))
    return sorted(found, key=lambda m: m["number"])


class _Lines:
    """What batch and stream writers share."""

    def __init__(self, options: dict[str, str], schema: T.StructType):
        if "line" not in schema.names:
            raise ValueError("rows to send need a line")
        self.at, self.has_cursor = _place(options), "cursor" in schema.names
        os.makedirs(os.path.join(self.at, "_committed"), exist_ok=True)

    def write(self, rows: Iterator) -> Sent:
        attempt, files, lines, cursor = uuid.uuid4().hex, [], 0, None
        out = None
        try:
            for row in rows:
                if row["line"] is None:
                    continue
                if lines % LINES == 0:
                    if out:
                        out.close()
                    files.append(f"part-{attempt}-{len(files):05d}.log")
                    out = open(os.path.join(self.at, files[-1]), "w", encoding="utf-8", newline="\n")
                out.write(row["line"] + "\n")
                lines += 1
                if self.has_cursor and row["cursor"] is not None and (cursor is None or row["cursor"] > cursor):
                    cursor = row["cursor"]
            if out:
                out.flush()
                os.fsync(out.fileno())
        except BaseException:
            self._drop(files)
            raise
        finally:
            if out:
                out.close()
        return Sent(files, lines, cursor)

    def _drop(self, files: list[str]) -> None:
        for name in files:
            try:
                os.remove(os.path.join(self.at, name))
            except FileNotFoundError:
                pass

    def _commit(self, messages: list, batch: str) -> None:
        sent = [m for m in messages if m is not None]
        name = os.path.join(self.at, "_committed", f"{batch}.json")
        if os.path.exists(name):  # this batch was sent before
            self._drop([f for m in sent for f in m.files])
            return
        before = manifests(self.at)
        cursors = [m["cursor"] for m in before if m["cursor"] is not None] + [m.cursor for m in sent if m.cursor is not None]
        body = {
            "batch": batch, "number": before[-1]["number"] + 1 if before else 0, "files": [f for m in sent for f in m.files],
            "lines": sum(m.lines for m in sent), "cursor": max(cursors, default=None),
        }
        side = f"{name}.{uuid.uuid4().hex}"
        with open(side, "w", encoding="utf-8") as f:
            json.dump(body, f)
            f.flush()
            os.fsync(f.fileno())
        os.rename(side, name)

    def _abort(self, messages: list) -> None:
        self._drop([f for m in messages if m is not None for f in m.files])


class BatchLines(_Lines, DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        super().__init__(options, schema)
        self.batch = f"batch-{options.get('batch') or uuid.uuid4().hex}"

    def commit(self, messages: list) -> None:
        self._commit(messages, self.batch)

    def abort(self, messages: list) -> None:
        self._abort(messages)


class StreamLines(_Lines, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, f"stream-{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:
        self._abort(messages)


class Sink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_sink"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("what was sent stays: use mode append")
        return BatchLines(dict(self.options), schema)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamWriter:
        return StreamLines(dict(self.options), schema)


def send(df: DataFrame, path: str, sink: str, batch: str | None = None) -> None:
    """Send the lines of df (line, optionally cursor) as one batch; a batch of a name that was sent before is not sent again."""
    df.sparkSession.dataSource.register(Sink)
    os.makedirs(local(path), exist_ok=True)
    keep = ["line", *[c for c in df.columns if c == "cursor"]]
    writer = df.select(*keep).write.format("tessera_sink").mode("append").option("sink", sink)
    (writer.option("batch", batch) if batch else writer).save(path)


def cursor(path: str, sink: str) -> str | None:
    """How far a sink has been sent."""
    done = manifests(_place({"path": path, "sink": sink}))
    return done[-1]["cursor"] if done else None


def send_since(df: DataFrame, path: str, sink: str, batch: str | None = None) -> int:
    """Send what lies beyond the sink's cursor; how many lines. df has line and cursor."""
    at = cursor(path, sink)
    send(df if at is None else df.where(F.col("cursor") > F.lit(at)), path, sink, batch)
    done = manifests(_place({"path": path, "sink": sink}))
    return done[-1]["lines"]


def sent(spark: SparkSession, path: str, sink: str) -> DataFrame:
    """The lines of all committed batches, with their batch."""
    at = _place({"path": path, "sink": sink})
    batches = [(f"{at}/{f}", m["batch"]) for m in manifests(at) for f in m["files"]]
    names = spark.createDataFrame(batches, "file string, batch string")
    if not batches:
        return spark.createDataFrame([], "batch string, line string")
    lines = spark.read.text([f for f, _ in batches]).select(F.col("value").alias("line"), F.regexp_extract("_metadata.file_path", "[^/]+$", 0).alias("name"))
    return lines.join(names.withColumn("name", F.regexp_extract("file", "[^/]+$", 0)), "name").select("batch", "line")
