"""The Parquet lake: schemas, partitioned writes, snapshots, views, incremental flush, compaction, file sources."""

from __future__ import annotations

import re
import uuid
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.manifest import Conflict, Log, Store, Version

BINARY, STRING, INT, LONG, DOUBLE = T.BinaryType(), T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
BOOLEAN, TIMESTAMP, DATE, COUNTS = T.BooleanType(), T.TimestampType(), T.DateType(), T.MapType(T.StringType(), T.IntegerType())


class Table(NamedTuple):
    """Columns with their types, the partition columns (last of the columns), and the time that orders the rows."""

    columns: tuple[tuple[str, T.DataType], ...]
    partitions: tuple[str, ...]
    ordered_by: str | None


# --- fixed values: columns of the lake's tables ------------------------------------------------------
TABLES = {
    "scan_results": Table(
        columns=(
            ("id", BINARY),
            ("job_id", BINARY),
            ("tenant_id", BINARY),
            ("file_path", STRING),
            ("file_name", STRING),
            ("file_size", LONG),
            ("file_modified", TIMESTAMP),
            ("content_hash", STRING),
            ("risk_score", INT),
            ("risk_tier", STRING),
            ("content_score", DOUBLE),
            ("exposure_multiplier", DOUBLE),
            ("exposure_level", STRING),
            ("owner", STRING),
            ("entity_counts", COUNTS),
            ("total_entities", INT),
            ("label_applied", BOOLEAN),
            ("current_label_name", STRING),
            ("current_label_id", STRING),
            ("recommended_label_name", STRING),
            ("label_applied_at", TIMESTAMP),
            ("label_error", STRING),
            ("policy_violations", STRING),
            ("scanned_at", TIMESTAMP),
            ("tenant", STRING),
            ("target", STRING),
            ("scan_date", DATE),
        ),
        partitions=("tenant", "target", "scan_date",),
        ordered_by="scanned_at",
    ),
    "file_inventory": Table(
        columns=(
            ("id", BINARY),
            ("tenant_id", BINARY),
            ("target_id", BINARY),
            ("folder_id", BINARY),
            ("file_path", STRING),
            ("file_name", STRING),
            ("adapter", STRING),
            ("content_hash", STRING),
            ("file_size", LONG),
            ("file_modified", TIMESTAMP),
            ("risk_score", INT),
            ("risk_tier", STRING),
            ("entity_counts", COUNTS),
            ("total_entities", INT),
            ("exposure_level", STRING),
            ("owner", STRING),
            ("current_label_name", STRING),
            ("current_label_id", STRING),
            ("label_applied_at", TIMESTAMP),
            ("is_monitored", BOOLEAN),
            ("needs_rescan", BOOLEAN),
            ("last_scanned_at", TIMESTAMP),
            ("discovered_at", TIMESTAMP),
            ("updated_at", TIMESTAMP),
            ("scan_count", INT),
            ("content_changed_count", INT),
            ("tenant", STRING),
            ("target", STRING),
        ),
        partitions=("tenant", "target",),
        ordered_by=None,
    ),
    "folder_inventory": Table(
        columns=(
            ("id", BINARY),
            ("tenant_id", BINARY),
            ("target_id", BINARY),
            ("folder_path", STRING),
            ("adapter", STRING),
            ("file_count", INT),
            ("total_size_bytes", LONG),
            ("folder_modified", TIMESTAMP),
            ("last_scanned_at", TIMESTAMP),
            ("has_sensitive_files", BOOLEAN),
            ("highest_risk_tier", STRING),
            ("total_entities_found", INT),
            ("discovered_at", TIMESTAMP),
            ("updated_at", TIMESTAMP),
            ("tenant", STRING),
            ("target", STRING),
        ),
        partitions=("tenant", "target",),
        ordered_by=None,
    ),
    "access_events": Table(
        columns=(
            ("id", BINARY),
            ("tenant_id", BINARY),
            ("monitored_file_id", BINARY),
            ("file_path", STRING),
            ("action", STRING),
            ("success", BOOLEAN),
            ("user_name", STRING),
            ("user_domain", STRING),
            ("user_sid", STRING),
            ("process_name", STRING),
            ("process_id", INT),
            ("event_source", STRING),
            ("event_time", TIMESTAMP),
            ("collected_at", TIMESTAMP),
            ("tenant", STRING),
            ("event_date", DATE),
        ),
        partitions=("tenant", "event_date",),
        ordered_by="event_time",
    ),
    "audit_log": Table(
        columns=(
            ("id", BINARY),
            ("tenant_id", BINARY),
            ("user_id", BINARY),
            ("action", STRING),
            ("resource_type", STRING),
            ("resource_id", BINARY),
            ("details", STRING),
            ("created_at", TIMESTAMP),
            ("tenant", STRING),
            ("log_date", DATE),
        ),
        partitions=("tenant", "log_date",),
        ordered_by="created_at",
    ),
    "directory_tree": Table(
        columns=(
            ("id", BINARY),
            ("tenant_id", BINARY),
            ("target_id", BINARY),
            ("dir_path", STRING),
            ("dir_name", STRING),
            ("parent_id", BINARY),
            ("dir_ref", LONG),
            ("parent_ref", LONG),
            ("sd_hash", BINARY),
            ("share_id", BINARY),
            ("dir_modified", TIMESTAMP),
            ("child_dir_count", INT),
            ("child_file_count", INT),
            ("flags", INT),
            ("discovered_at", TIMESTAMP),
            ("updated_at", TIMESTAMP),
            ("tenant", STRING),
            ("target", STRING),
        ),
        partitions=("tenant", "target",),
        ordered_by=None,
    ),
    "remediation_actions": Table(
        columns=(
            ("id", BINARY),
            ("tenant_id", BINARY),
            ("file_inventory_id", BINARY),
            ("action_type", STRING),
            ("status", STRING),
            ("source_path", STRING),
            ("dest_path", STRING),
            ("performed_by", STRING),
            ("dry_run", BOOLEAN),
            ("error", STRING),
            ("created_at", TIMESTAMP),
            ("completed_at", TIMESTAMP),
            ("tenant", STRING),
            ("action_date", DATE),
        ),
        partitions=("tenant", "action_date",),
        ordered_by="created_at",
    ),
}
# --- end of fixed values ---------------------------------------------------------------------------
COMPACT_AT = 10


def schema(name: str) -> T.StructType:
    """The table's columns, partition columns last."""
    return T.StructType([T.StructField(column, kind) for column, kind in TABLES[name].columns])


def partitions(name: str) -> tuple[str, ...]:
    return TABLES[name].partitions


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the table's columns and types; what it lacks is null. 16-byte ids may come as text."""

    def column(f: T.StructField) -> Column:
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        have = df.schema[f.name].dataType
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType) and isinstance(have, T.StringType):
            return F.unhex(F.replace(c, F.lit("-"))).alias(f.name)
        if isinstance(f.dataType, T.StringType) and isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(c).alias(f.name)
        return c.cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in schema(name)])


class Lake:
    """Tables below one root, on any filesystem Spark can write. What a table holds is what its newest version names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Store(spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def log(self, name: str) -> Log:
        return Log(self.store, name)

    def exists(self, name: str) -> bool:
        return bool(self.log(name).numbers())

    def _files(self, df: DataFrame, name: str) -> dict[str, int]:
        """Write rows as files that no version names yet. A partition's rows are gathered, and split again beyond the advised size."""
        keys, job = partitions(name), uuid.uuid4().hex
        order = [c for c in (*keys, TABLES[name].ordered_by) if c]
        side = f"{name}/_staged/{job}"
        rows = conform(df, name).hint("rebalance", *keys).sortWithinPartitions(*order)
        rows.write.option("compression", "zstd").partitionBy(*keys).parquet(f"{self.root}/{side}")
        added = {}
        for f, size in self.store.files(side).items():
            folder, _, leaf = f.rpartition("/")
            target = f"{folder}/{job}-{leaf}"
            self.store.rename(f"{side}/{f}", f"{name}/{target}")
            added[target] = size
        self.store.delete(side)
        return added

    def append(self, df: DataFrame, name: str, notes: dict[str, str] | None = None) -> None:
        """Add rows, and notes if given, in one version."""
        self.log(name).commit(self._files(df, name), notes=notes)

    def append_once(self, df: DataFrame, name: str, stream: str, batch: int) -> bool:
        """Add a stream's batch unless it was added before; for foreachBatch, which may run one twice."""
        note = f"stream:{stream}"

        def new(now: Version) -> bool:
            return batch > int(now.notes.get(note, -1))

        def check(now: Version) -> None:
            if not new(now):
                raise Conflict(f"batch {batch} of {stream} is there")

        if not new(self.log(name).read()):
            return False
        self.log(name).commit(self._files(df, name), notes={note: str(batch)}, check=check)
        return True

    def snapshot(self, df: DataFrame, name: str) -> None:
        """Replace the partitions that df has rows for, and only these."""
        added = self._files(df, name)
        leaves = {f.rpartition("/")[0] for f in added}
        self.log(name).commit(added, lambda now: [f for f in now.files if f.rpartition("/")[0] in leaves])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table, or one of its versions, by its declared schema; an absent table is empty."""
        return self._read(name, self.log(name).read(version).files)

    def _read(self, name: str, files) -> DataFrame:
        s = schema(name)
        if not files:
            return self.spark.createDataFrame([], s)
        return self.spark.read.schema(s).option("basePath", self.path(name)).parquet(*[f"{self.path(name)}/{f}" for f in sorted(files)])

    def views(self, tenant: str | None = None) -> None:
        """Temp views of all tables, of one tenant's rows if named."""
        for name in TABLES:
            df = self.read(name)
            (df if tenant is None else df.where(F.col("tenant") == tenant)).createOrReplaceTempView(name)

    def refresh(self, name: str) -> None:
        self.read(name).createOrReplaceTempView(name)

    def flush_since(self, source: DataFrame, name: str, column: str, after) -> tuple[int, object]:
        """Append source rows beyond the cursor; how many, and the new cursor (the old one if there were none)."""
        new = source if after is None else source.where(F.col(column) > F.lit(after).cast(source.schema[column].dataType))
        n, top = new.agg(F.count("*"), F.max(column)).first()
        if n:
            self.append(new.where(F.col(column) <= F.lit(top)), name)
        return n, top if n else after

    def flush(self, source: DataFrame, name: str, column: str) -> int:
        """Append the source rows beyond the table's own cursor; rows and cursor are one version, so neither is lost or doubled."""
        note = f"cursor:{column}"
        before = self.log(name).read().notes.get(note)
        kind = source.schema[column].dataType
        new = source if before is None else source.where(F.col(column) > F.lit(before).cast(kind))
        n, top = new.agg(F.count("*"), F.max(column).cast("string")).first()
        if n:
            def check(now: Version) -> None:
                if now.notes.get(note) != before:
                    raise Conflict(f"another flush moved the cursor of {name}")

            self.log(name).commit(self._files(new.where(F.col(column) <= F.lit(top).cast(kind)), name), notes={note: top}, check=check)
        return n

    def rebuild(self, tables: dict[str, DataFrame]) -> None:
        """Export whole tables anew: each becomes what its DataFrame holds, in one version."""
        for name, df in tables.items():
            self.log(name).commit(self._files(df, name), lambda now: list(now.files))

    def leaves(self, name: str) -> dict[str, int]:
        """Data files by leaf partition: from the file list, without reading data."""
        out: dict[str, int] = {}
        for f in self.log(name).read().files:
            leaf = f.rpartition("/")[0]
            out[leaf] = out.get(leaf, 0) + 1
        return out

    def compact(self, name: str, threshold: int = COMPACT_AT) -> list[str]:
        """Leaf partitions of `threshold` files or more are written anew, sorted, in files of the advised size. Readers see the old files or the new ones."""
        now = self.log(name).read().files
        dense = sorted(leaf for leaf, n in self.leaves(name).items() if n >= threshold)
        old = [f for f in now if f.rpartition("/")[0] in set(dense)]
        if old:
            self.log(name).commit(self._files(self._read(name, old), name), old)
        return dense

    def delete_where(self, name: str, condition: Column | str, tries: int = 3) -> int:
        """Delete the rows for which the condition holds; only files that have such rows are written anew. How many files."""
        holds = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
        for again in range(tries):
            now = self.log(name).read().files
            if not now:
                return 0
            # one row per file that is hit
            hit = {r[0] for r in self._read(name, now).where(holds).select("_metadata.file_name").distinct().collect()}
            old = [f for f in now if f.rpartition("/")[2] in hit]
            if not old:
                return 0
            try:
                self.log(name).commit(self._files(self._read(name, old).where(~holds), name), old)
                return len(old)
            except Conflict:
                if again == tries - 1:
                    raise
        return 0

    def vacuum(self, name: str, keep: int = 1, older_ms: int = 7 * 86_400_000) -> list[str]:
        """Delete files that none of the last versions names; older ones only, since a job may be about to commit its own."""
        return self.log(name).vacuum(keep, older_ms)


def storage_options(kind: str, **k: str) -> dict[str, str]:
    """Hadoop settings of a remote store, for spark.hadoop.*; credentials come from the caller."""
    if kind == "s3":
        out = {"fs.s3a.endpoint": k.get("endpoint", ""), "fs.s3a.access.key": k.get("access_key", ""), "fs.s3a.secret.key": k.get("secret_key", ""), "fs.s3a.path.style.access": "true" if k.get("endpoint") else "", "fs.s3a.endpoint.region": k.get("region", "")}
    elif kind == "azure":
        account = k["account"]
        out = {f"fs.azure.account.key.{account}.dfs.core.windows.net": k.get("key", "")}
    elif kind == "local":
        out = {}
    else:
        raise ValueError(f"unknown store {kind}")
    return {a: b for a, b in out.items() if b}


# --- file sources ------------------------------------------------------------------------------------
def list_files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Path, name, size and time of the files below a root; their contents are not read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    return f.select(F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"), F.col("modificationTime").alias("file_modified"))


def read_files(spark: SparkSession, root: str, glob: str = "*", most_bytes: int = 50 << 20) -> DataFrame:
    """Files with their contents; larger ones are left out by their listed size, before they are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most_bytes)


def extract_text(name: str, content: bytes | None) -> tuple[str, str | None]:
    """Text of a file by its extension, and what went wrong."""
    import csv
    import email
    import email.policy
    import io
    import zipfile
    from html.parser import HTMLParser

    if content is None:
        return "", "no content"
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    decode = lambda b: b.decode("utf-8-sig", "replace")
    try:
        if ext in ("html", "htm", "xhtml"):
            class Reader(HTMLParser):
                def __init__(self):
                    super().__init__()
                    self.parts, self.skip = [], 0

                def handle_starttag(self, tag, attrs):
                    self.skip += tag in ("script", "style")

                def handle_endtag(self, tag):
                    self.skip -= tag in ("script", "style") and self.skip > 0

                def handle_data(self, data):
                    if not self.skip and data.strip():
                        self.parts.append(data.strip())

            r = Reader()
            r.feed(decode(content))
            return "\n".join(r.parts), None
        if ext in ("csv", "tsv"):
            return "\n".join(" ".join(row) for row in csv.reader(io.StringIO(decode(content)), delimiter="\t" if ext == "tsv" else ",")), None
        if ext in ("eml", "msg"):
            m = email.message_from_bytes(content, policy=email.policy.default)
            body = m.get_body(("plain", "html"))
            head = [f"{k}: {m[k]}" for k in ("From", "To", "Subject") if m[k]]
            return "\n".join([*head, body.get_content() if body else ""]), None
        if ext in ("docx", "pptx", "xlsx"):
            inner = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "xlsx": r"xl/(?:sharedStrings|worksheets/sheet\d+)\.xml"}[ext]
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                raw = "\n".join(decode(z.read(n)) for n in sorted(z.namelist()) if re.fullmatch(inner, n))
            raw = re.sub(r"</(?:w:p|a:p|si|row)>", "\n", raw)
            import html

            return html.unescape(re.sub(r"<[^>]+>", "", raw)).strip(), None
        if ext == "rtf":
            t = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), decode(content))
            t = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", t)
            t = re.sub(r"\\par[d]?\b ?", "\n", t)
            return re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", t).strip(), None
        if ext in ("pdf", "png", "jpg", "jpeg", "tiff", "gif", "bmp"):
            return "", f"no reader for {ext} here"
        return decode(content), None
    except Exception as e:  # a broken file is a row with an error, not a failed job
        return "", f"{type(e).__name__}: {e}"[:200]


def extracted(files: DataFrame) -> DataFrame:
    """Files (path, content) with text and error."""

    @F.pandas_udf("text string, error string")
    def read(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        got = [extract_text(n, c) for n, c in zip(names, contents)]
        return pd.DataFrame({"text": [t for t, _ in got], "error": [e for _, e in got]})

    return files.withColumn("__r", read("path", "content")).select("path", F.col("__r.text").alias("text"), F.col("__r.error").alias("error"))
