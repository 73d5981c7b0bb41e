"""Change feeds as streams: pages of changes that a poller or a webhook receiver lays down, read in order, each once.

A feed is a folder of pages `<number>.json`, each one delta response: {"value": [items], "token": ...}. The stream's
offset is the number of the last page taken, kept in the stream's checkpoint, so a restart goes on behind it and
a batch that failed is read again as it was. Only page names pass through the driver; executors read the pages.

Options: path, maxPages (pages of one batch; the others wait), queue and overflow. With overflow=drop the feed is a
bounded queue: of the pages that wait at a poll the first `queue` are taken and the later ones are dropped for good,
as a receiver does that refuses what no longer fits. A page's number decides, so a replay drops the same ones. The
delta query behind such notifications finds the dropped changes again, by the token of the last page taken.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tessera.sources.files import local

#: Notifications that a queue holds; pages of one batch.
QUEUE, MAX_PAGES = 10_000, 1_000
ITEM = (
    "id string, name string, folder string, file string, deleted string, lastModifiedDateTime string,"
    " parentReference struct<path:string>, lastModifiedBy struct<user:struct<email:string,displayName:string>>"
)


def page_name(number: int) -> str:
    return f"{number:012d}.json"


def put_page(path: str, number: int, items: list[dict], token: str | None = None) -> None:
    """Lay down a page, whole or not at all."""
    at = os.path.join(local(path), page_name(number))
    with open(at + ".writing", "w", encoding="utf-8") as f:
        json.dump({"value": items, "token": token or str(number)}, f)
    os.replace(at + ".writing", at)


class Pages(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = local(options["path"])
        self.most = int(options.get("maxpages", options.get("maxPages", MAX_PAGES)))
        self.queue = int(options.get("queue", QUEUE))
        self.drop = options.get("overflow", "wait") == "drop"

    def initialOffset(self) -> dict:
        return {"page": -1}

    def _between(self, after: int, last: int | None) -> list[int]:
        numbers = [int(n[:-5]) for n in os.listdir(self.path) if n.endswith(".json") and n[:-5].isdigit()]
        return sorted(n for n in numbers if n > after and (last is None or n <= last))

    def _rows(self, numbers: list[int]) -> Iterator[tuple]:
        return iter([(n, os.path.join(self.path, page_name(n))) for n in (numbers[: self.queue] if self.drop else numbers)])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        waiting = self._between(start["page"], None)
        if not self.drop:
            waiting = waiting[: self.most]
        return self._rows(waiting), {"page": waiting[-1] if waiting else start["page"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(self._between(start["page"], end["page"]))

    def commit(self, end: dict) -> None:
        pass


class Changes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_changes"

    def schema(self) -> str:
        return "page long, path string"

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        return Pages(dict(self.options))


def feed(spark: SparkSession, path: str, **options) -> DataFrame:
    """The stream of a feed's items: page, token, and item as JSON."""
    spark.dataSource.register(Changes)
    pages = spark.readStream.format("tessera_changes").options(**options).load(path)
    return items(pages)


def items(pages: DataFrame) -> DataFrame:
    """The items of pages (page, path), read where the tasks run; the JSON of each stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open(path, encoding="utf-8") as f:
                    page = json.load(f)
                found = [json.dumps(i) for i in page["value"]]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int64()), pa.array([page["token"]] * len(found), pa.string()), pa.array(found, pa.string())], names=["page", "token", "item"])

    return pages.mapInArrow(run, "page long, token string, item string")


def file_events(changes: DataFrame) -> DataFrame:
    """Write events of changed files: folders, deleted items and items without a name make none."""
    x = changes.select("page", F.from_json("item", ITEM).alias("i")).where("i.folder is null and i.deleted is null and length(i.name) > 0")
    parent = F.replace(F.coalesce("i.parentReference.path", F.lit("")), F.lit("/drive/root:"), F.lit(""))
    return x.select(
        "page", F.concat(parent, F.lit("/"), F.col("i.name")).alias("file_path"), F.to_timestamp("i.lastModifiedDateTime").alias("event_time"), F.lit("write").alias("action"),
        F.coalesce("i.lastModifiedBy.user.email", "i.lastModifiedBy.user.displayName").alias("user_name"),
    )
