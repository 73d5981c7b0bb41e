"""File trees as a data source: `spark.read.format("tessera_files")` lists files or folders, or reads files whole; writing puts files.

A listing is partitioned: the root's folders are opened level by level until there are `fanout` of them, and each task
walks some subtrees. Filters on the columns below are taken over by the source, so that subtrees outside a prefix are
never opened and no row is made of a file that does not fit:

- file_path, folder: equality and prefix (`startswith`, `LIKE 'x%'`);
- extension: equality and `IN`;
- file_size, file_modified: comparisons.

Options: path (the root, on a filesystem that driver and executors mount), kind (`files`, `folders` or `contents`),
fanout, maxBytes (a larger file has no content). Links are not followed; files that vanish during the walk and folders
that may not be read are left out. Call `register` once a session.
"""

from __future__ import annotations

import datetime
import os
import stat
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)

FILES = "file_path string, file_name string, extension string, folder string, file_size long, file_modified timestamp, owner string, group string, mode int"
SCHEMAS = {
    "files": FILES,
    "folders": "folder string, parent string, depth int, n_files long, n_bytes long, folder_modified timestamp, owner string, group string, mode int",
    "contents": FILES + ", content binary",
}
#: Columns that are never null.
WHOLE = {"file_path", "file_name", "folder", "file_size", "file_modified", "mode"}
FANOUT, MAX_BYTES, BATCH = 64, 100 << 20, 4096
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def local(path: str) -> str:
    """A path of the operating system from a path or a file: URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return os.path.normpath(path)


@dataclass
class Wanted:
    """What the pushed filters leave."""

    prefixes: tuple[str, ...] = ()
    folders: tuple[str, ...] | None = None
    paths: tuple[str, ...] | None = None
    extensions: tuple[str, ...] | None = None
    ranges: tuple[tuple[str, str, Any], ...] = ()

    def take(self, f: Filter) -> bool:
        """Whether the filter is taken over, exactly."""
        if isinstance(f, IsNotNull):
            return len(f.attribute) == 1 and f.attribute[0] in WHOLE
        if len(getattr(f, "attribute", ())) != 1:
            return False
        column, value = f.attribute[0], getattr(f, "value", None)
        both = lambda old, new: tuple(new) if old is None else tuple(v for v in old if v in new)
        if isinstance(f, StringStartsWith) and column in ("file_path", "folder"):
            self.prefixes += ((column, value),)
        elif isinstance(f, EqualTo) and column == "folder":
            self.folders = both(self.folders, (value,))
        elif isinstance(f, EqualTo) and column == "file_path":
            self.paths = both(self.paths, (value,))
        elif isinstance(f, EqualTo) and column == "extension":
            self.extensions = both(self.extensions, (value,))
        elif isinstance(f, In) and column == "extension":
            self.extensions = both(self.extensions, f.value)
        elif column in ("file_size", "file_modified") and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            if column == "file_modified":
                if not isinstance(value, datetime.datetime):
                    return False
                value = value.timestamp()
            self.ranges += ((column, type(f).__name__, value),)
        else:
            return False
        return True

    def opens(self, folder: str) -> bool:
        """Whether the folder or one below it can hold what is wanted."""
        at = folder.rstrip("/") + "/"
        fits = lambda want: want.startswith(at) or at.startswith(want) or folder.startswith(want)
        if not all(fits(p) for _, p in self.prefixes):
            return False
        for exact in (self.folders, self.paths):
            if exact is not None and not any(e == folder or e.startswith(at) for e in exact):
                return False
        return True

    def folder(self, folder: str) -> bool:
        return all(folder.startswith(p) for c, p in self.prefixes if c == "folder") and (self.folders is None or folder in self.folders)

    def file(self, path: str, extension: str | None) -> bool:
        return (
            all(path.startswith(p) for c, p in self.prefixes if c == "file_path")
            and (self.paths is None or path in self.paths) and (self.extensions is None or extension in self.extensions)
        )

    def status(self, s: os.stat_result) -> bool:
        for column, kind, value in self.ranges:
            have = s.st_size if column == "file_size" else s.st_mtime_ns // 1000 / 1e6
            if not {"GreaterThan": have > value, "GreaterThanOrEqual": have >= value, "LessThan": have < value, "LessThanOrEqual": have <= value}[kind]:
                return False
        return True


def extension(name: str) -> str | None:
    """The lower-case ending after the last dot of a name, if there is one."""
    stem, dot, end = name.rpartition(".")
    return end.lower() if dot and stem else None


_names: dict[tuple[str, int], str] = {}


def _name(kind: str, number: int) -> str:
    """A user's or group's name; its number where it has none."""
    if (kind, number) not in _names:
        import grp
        import pwd

        try:
            _names[kind, number] = pwd.getpwuid(number).pw_name if kind == "user" else grp.getgrgid(number).gr_name
        except KeyError:
            _names[kind, number] = str(number)
    return _names[kind, number]


def _scan(folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as entries:
            return sorted(entries, key=lambda e: e.name)
    except (PermissionError, FileNotFoundError, NotADirectoryError):
        return []


class Subtrees(InputPartition):
    """(folder, whether to go below it) of one task."""

    def __init__(self, folders: list[tuple[str, bool]]):
        super().__init__(folders)


class FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.root = local(options["path"])
        self.kind = options.get("kind", "files")
        self.fanout, self.most = int(options.get("fanout", FANOUT)), int(options.get("maxbytes", options.get("maxBytes", MAX_BYTES)))
        self.schema, self.wanted = schema, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        if self.kind == "folders":
            mine = [f for f in filters if getattr(f, "attribute", None) == ("folder",)]
        else:
            mine = filters
        for f in filters:
            if f not in mine or not self.wanted.take(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise ValueError(f"{self.root} is no folder")
        level, shallow = [self.root] if self.wanted.opens(self.root) else [], []
        while level and len(level) < self.fanout:
            below = [e.path for d in level for e in _scan(d) if e.is_dir(follow_symlinks=False) and self.wanted.opens(e.path)]
            shallow += level
            level = below
        parts = max(1, min(self.fanout, len(level) + len(shallow)))
        todo = [(d, True) for d in level] + [(d, False) for d in shallow]
        return [Subtrees(todo[i::parts]) for i in range(parts)]

    def _walk(self, folder: str, deep: bool) -> Iterator[tuple[str, list[os.DirEntry]]]:
        stack = [folder]
        while stack:
            at = stack.pop()
            entries = _scan(at)
            yield at, [e for e in entries if e.is_file(follow_symlinks=False)]
            if deep:
                stack += [e.path for e in reversed(entries) if e.is_dir(follow_symlinks=False) and self.wanted.opens(e.path)]

    def _files(self, folder: str, files: list[os.DirEntry]) -> Iterator[tuple]:
        if not self.wanted.folder(folder):
            return
        for e in files:
            end = extension(e.name)
            if not self.wanted.file(e.path, end):
                continue
            try:
                s = e.stat(follow_symlinks=False)
                if not self.wanted.status(s):
                    continue
                row = (e.path, e.name, end, folder, s.st_size, s.st_mtime_ns // 1000, _name("user", s.st_uid), _name("group", s.st_gid), stat.S_IMODE(s.st_mode))
                if self.kind == "contents":
                    content = None
                    if s.st_size <= self.most:
                        with open(e.path, "rb") as f:
                            content = f.read()
                    row += (content,)
            except FileNotFoundError:
                continue
            yield row

    def _folder(self, folder: str, files: list[os.DirEntry]) -> Iterator[tuple]:
        if not self.wanted.folder(folder):
            return
        try:
            s = os.stat(folder)
            sizes = [e.stat(follow_symlinks=False).st_size for e in files]
        except FileNotFoundError:
            return
        depth = 0 if folder == self.root else os.path.relpath(folder, self.root).count("/") + 1
        parent = os.path.dirname(folder) if depth else None
        yield folder, parent, depth, len(sizes), sum(sizes), s.st_mtime_ns // 1000, _name("user", s.st_uid), _name("group", s.st_gid), stat.S_IMODE(s.st_mode)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        arrow = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.TimestampType: pa.timestamp("us", tz="UTC"), T.BinaryType: pa.binary()}
        fields = [pa.field(f.name, arrow[type(f.dataType)]) for f in self.schema.fields]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=pa.schema(fields))

        for folder, deep in partition.value:
            for at, files in self._walk(folder, deep):
                for row in (self._folder if self.kind == "folders" else self._files)(at, files):
                    rows.append(row)
                    held += len(row[-1]) if self.kind == "contents" and row[-1] else 0
                    if len(rows) >= BATCH or held > 16 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


@dataclass
class Put(WriterCommitMessage):
    files: int
    bytes: int


class FilesWriter(DataSourceWriter):
    """Rows (path below the root, content) become files. A file appears whole or not at all; a task that runs twice writes the same files."""

    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.root = local(options["path"])
        if {"path", "content"} - set(schema.names):
            raise ValueError("rows to write need path and content")

    def write(self, rows: Iterator) -> Put:
        n = size = 0
        for row in rows:
            target = os.path.normpath(os.path.join(self.root, row["path"]))
            if not target.startswith(self.root.rstrip("/") + "/"):
                raise ValueError(f"{row['path']} leaves the root")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            side = f"{target}.{uuid.uuid4().hex}.writing"
            try:
                with open(side, "wb") as f:
                    f.write(bytes(row["content"] or b""))
                os.replace(side, target)
            except BaseException:
                if os.path.exists(side):
                    os.remove(side)
                raise
            n, size = n + 1, size + len(row["content"] or b"")
        return Put(n, size)

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        pass


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_files"

    def schema(self) -> str:
        kind = self.options.get("kind", "files")
        if kind not in SCHEMAS:
            raise ValueError(f"kind must be one of {', '.join(SCHEMAS)}")
        return SCHEMAS[kind]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FilesReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are put one by one: use mode append")
        return FilesWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """The source by name, and the session's switch that lets sources written in Python take filters."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Files)


def list_folders(spark: SparkSession, root: str) -> DataFrame:
    register(spark)
    return spark.read.format("tessera_files").option("kind", "folders").load(root)


def list_tree(spark: SparkSession, root: str, contents: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("tessera_files").option("kind", "contents" if contents else "files").load(root)


def put_files(df: DataFrame, root: str) -> None:
    """Write (path, content) rows as files below the root."""
    register(df.sparkSession)
    os.makedirs(local(root), exist_ok=True)
    df.select("path", "content").write.format("tessera_files").mode("append").save(root)


def remove_files(paths: DataFrame, root: str, column: str = "file_path") -> int:
    """Delete the files named in a column, all of which must lie below the root; how many were there."""
    at = local(root).rstrip("/") + "/"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = 0
            for p in b.column(0).to_pylist():
                p = local(p)
                if not p.startswith(at):
                    raise ValueError(f"{p} leaves the root")
                try:
                    os.remove(p)
                    n += 1
                except FileNotFoundError:
                    pass
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return paths.select(column).mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
