"""Row transforms: audit records, masks, journals, exposure, queue upkeep, formats and scalar functions."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import taxonomy as X
from tessera.catalogue import query
from tessera.plans.base import EMAIL, NOW, SQL, access_events, files, scan_results
from tessera.plans.dashboard import JOBS, jobs, with_violations
from tessera.session import table

# --- fixed values: operations and masks of the event sources ----------------------------------------
OPERATIONS = {
    "FileAccessed": "read",
    "FileAccessedExtended": "read",
    "FilePreviewed": "read",
    "FileDownloaded": "read",
    "FileSyncDownloadedFull": "read",
    "FileSyncDownloadedPartial": "read",
    "FileCopied": "read",
    "FileModified": "write",
    "FileModifiedExtended": "write",
    "FileUploaded": "write",
    "FileSyncUploadedFull": "write",
    "FileSyncUploadedPartial": "write",
    "FileCheckedOut": "write",
    "FileCheckedIn": "write",
    "FileRestored": "write",
    "FileDeleted": "delete",
    "FileDeletedFirstStageRecycleBin": "delete",
    "FileDeletedSecondStageRecycleBin": "delete",
    "FileRecycled": "delete",
    "FileVersionsAllDeleted": "delete",
    "FileMoved": "rename",
    "FileRenamed": "rename",
    "SharingSet": "permission_change",
    "SharingRevoked": "permission_change",
    "SharingInheritanceBroken": "permission_change",
    "SharingInheritanceReset": "permission_change",
    "AnonymousLinkCreated": "permission_change",
    "AnonymousLinkUpdated": "permission_change",
    "AnonymousLinkRemoved": "permission_change",
    "CompanyLinkCreated": "permission_change",
    "CompanyLinkRemoved": "permission_change",
    "AddedToSecureLink": "permission_change",
    "RemovedFromSecureLink": "permission_change",
}
# Journal reasons: data and named data overwritten, extended, truncated, or a file made, are writes; so is the rest.
USN = (("delete", 0x200), ("rename", 0x1000 | 0x2000), ("permission_change", 0x800), ("write", 0x1 | 0x2 | 0x4 | 0x10 | 0x20 | 0x40 | 0x100))
# Deleted or self deleted; moved from, to or self moved; modified, closed after writing or made; accessed. The rest are writes.
FANOTIFY = (("delete", 0x200 | 0x400), ("rename", 0x40 | 0x80 | 0x800), ("write", 0x2 | 0x8 | 0x100), ("read", 0x1))
ACCESS_MASK = (("read", 0x1), ("write", 0x2), ("write", 0x4), ("delete", 0x10000), ("permission_change", 0x40000))
SYSTEM_ACCOUNTS = ("SYSTEM", "LOCAL SERVICE", "NETWORK SERVICE", "DWM-1", "DWM-2", "DWM-3", "UMFD-0", "UMFD-1")
SYSTEM_SIDS = ("S-1-5-18", "S-1-5-19", "S-1-5-20")
LINUX_ACCOUNTS = ("root", "nobody", "daemon", "bin", "sys")
# --- end of fixed values ---------------------------------------------------------------------------


def by_mask(mask: Column, bits, default: str | None) -> Column:
    """The first action in order whose bits meet the mask."""
    out = F.lit(default)
    for action, b in reversed(bits):
        out = F.when(mask.bitwiseAND(F.lit(b).cast("long")) != 0, action).otherwise(out)
    return out


_FANOTIFY_MASK = "((l_partkey * 37 + l_linenumber) % 4096)"


@query("fanotify_actions", f"SELECT l_orderkey * 8 + l_linenumber AS id, case when {_FANOTIFY_MASK} & 1536 <> 0 then 'delete' when {_FANOTIFY_MASK} & 2240 <> 0 then 'rename' when {_FANOTIFY_MASK} & 266 <> 0 then 'write' when {_FANOTIFY_MASK} & 1 <> 0 then 'read' else 'write' end AS action FROM lineitem")
def fanotify_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), by_mask(F.expr(_FANOTIFY_MASK).cast("long"), FANOTIFY, "write").alias("action"))


_ACCESS = "(1::bigint << (o_orderkey % 20)::int)"


@query("windows_access_mask", f"SELECT o_orderkey AS id, case when {_ACCESS} & 1 <> 0 then 'read' when {_ACCESS} & 6 <> 0 then 'write' when {_ACCESS} & 65536 <> 0 then 'delete' when {_ACCESS} & 262144 <> 0 then 'permission_change' else 'unknown' end AS action, try_cast('1' || o_custkey AS int) AS pid FROM orders")
def windows_access_mask(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    mask = F.expr("shiftleft(1L, cast(o_orderkey % 20 as int))")
    return o.select(F.col("o_orderkey").alias("id"), by_mask(mask, ACCESS_MASK, "unknown").alias("action"), F.concat(F.lit("1"), F.col("o_custkey").cast("string")).try_cast("int").alias("pid"))


_M365_SQL = """WITH o AS (SELECT event_id, ts, user_id, (['FileAccessed', 'FileAccessedExtended', 'FilePreviewed', 'FileDownloaded', 'FileSyncDownloadedFull', 'FileSyncDownloadedPartial', 'FileCopied',
  'FileModified', 'FileModifiedExtended', 'FileUploaded', 'FileSyncUploadedFull', 'FileSyncUploadedPartial', 'FileCheckedOut', 'FileCheckedIn', 'FileRestored',
  'FileDeleted', 'FileDeletedFirstStageRecycleBin', 'FileDeletedSecondStageRecycleBin', 'FileRecycled', 'FileVersionsAllDeleted', 'FileMoved', 'FileRenamed', 'SharingSet', 'SharingRevoked', 'SharingInheritanceBroken', 'SharingInheritanceReset',
  'AnonymousLinkCreated', 'AnonymousLinkUpdated', 'AnonymousLinkRemoved', 'CompanyLinkCreated', 'CompanyLinkRemoved', 'AddedToSecureLink', 'RemovedFromSecureLink', 'UserLoggedIn'])[event_id % 34 + 1] AS op FROM events)
SELECT event_id, case when op like '%Delete%' or op like '%Recycle%' then 'delete' when op in ('FileMoved', 'FileRenamed') then 'rename' when op like 'Sharing%' or op like '%Link%' then 'permission_change'
  when op like '%Modified%' or op like '%Upload%' or op like 'FileChecked%' or op = 'FileRestored' then 'write' when op <> 'UserLoggedIn' then 'read' end AS action,
  'https://site' || (user_id % 3) || '/f' || event_id AS path, 'u' || user_id AS user_name, date_trunc('second', ts) AS event_time FROM o WHERE op <> 'UserLoggedIn' AND user_id % 3 = 1"""


@query("m365_audit_parse", _M365_SQL)
def m365_audit_parse(spark, sf_dir, site: str = "https://site1/"):
    """Audit records (JSON) to events: file operations below a site only."""
    e = table(spark, sf_dir, "events")
    op = F.element_at(F.array(*[F.lit(x) for x in [*OPERATIONS, "UserLoggedIn"]]), (F.col("event_id") % (len(OPERATIONS) + 1) + 1).cast("int"))
    record = F.to_json(F.struct(op.alias("Operation"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("CreationTime"), F.concat(F.lit("https://site"), (F.col("user_id") % 3).cast("string"), F.lit("/f"), F.col("event_id").cast("string")).alias("ObjectId"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("UserId")))
    r = e.select("event_id", F.from_json(record, "Operation string, CreationTime string, ObjectId string, SourceRelativeUrl string, UserId string").alias("r"))
    action = X.literal_map(OPERATIONS)[F.col("r.Operation")]
    out = r.select("event_id", action.alias("action"), F.coalesce("r.ObjectId", "r.SourceRelativeUrl").alias("path"), F.col("r.UserId").alias("user_name"), F.to_timestamp("r.CreationTime").alias("event_time"))
    return out.where(F.col("action").isNotNull() & F.col("path").startswith(site))


@query("auditd_parse", "SELECT event_id, date_trunc('second', ts) AS event_time, 'user' || user_id AS user_name, case event_type when 'view' then 'read' when 'purchase' then 'write' else 'unknown' end AS action FROM events WHERE event_type IN ('view', 'purchase', 'signup')")
def auditd_parse(spark, sf_dir):
    """CSV audit lines to events by keywords of the event type."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase", "signup"))
    kind = X.literal_map({"view": "open-read", "purchase": "file-write", "signup": "login"})[F.col("event_type")]
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.concat(F.lit("user"), F.col("user_id").cast("string")), kind)
    c = F.from_csv(line, F.lit("id long, at string, user string, kind string"))
    low = F.lower("c.kind")
    action = F.when(low.contains("delete") | low.contains("unlink"), "delete").when(low.contains("rename"), "rename").when(low.contains("write"), "write").when(low.contains("chmod") | low.contains("chown"), "permission_change").when(low.contains("read") | low.contains("open"), "read").otherwise("unknown")
    return e.select(c.alias("c")).select(F.col("c.id").alias("event_id"), F.to_timestamp("c.at").alias("event_time"), F.col("c.user").alias("user_name"), action.alias("action"))


_ACCOUNTS = ("SYSTEM", "system", "Local Service", "NETWORK SERVICE", "dwm-1", "DWM-2", "DWM-3", "UMFD-0", "umfd-1", "S-1-5-18", "S-1-5-19", "S-1-5-20", "root", "nobody", "daemon", "bin", "sys", "Root", "DWM-4", "s-1-5-18", "messagebus", "john")


@query("system_account_filter", "SELECT id, account FROM (SELECT o_orderkey AS id, (['SYSTEM', 'system', 'Local Service', 'NETWORK SERVICE', 'dwm-1', 'DWM-2', 'DWM-3', 'UMFD-0', 'umfd-1', 'S-1-5-18', 'S-1-5-19', 'S-1-5-20', 'root', 'nobody', 'daemon', 'bin', 'sys', 'Root', 'DWM-4', 's-1-5-18', 'messagebus', 'john'])[o_orderkey % 22 + 1] AS account FROM orders) WHERE account IN ('Root', 'DWM-4', 's-1-5-18', 'messagebus', 'john')")
def system_account_filter(spark, sf_dir):
    """Accounts but those of the system: Windows names in any case, SIDs and Linux names as they are written."""
    account = F.element_at(F.array(*[F.lit(x) for x in _ACCOUNTS]), (F.col("o_orderkey") % len(_ACCOUNTS) + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), account.alias("account"))
    return o.where(~F.upper("account").isin(*SYSTEM_ACCOUNTS) & ~F.col("account").isin(*SYSTEM_SIDS) & ~F.col("account").isin(*LINUX_ACCOUNTS))


def usn_record(name: str, reason: int, usn: int, at: datetime) -> bytes:
    """One journal record (version 2): 60 bytes of header, then the name in UTF-16LE, padded to 8 bytes."""
    raw = name.encode("utf-16-le")
    size = (60 + len(raw) + 7) // 8 * 8
    filetime = int((at - datetime(1601, 1, 1, tzinfo=timezone.utc)).total_seconds() * 10_000_000)
    head = struct.pack("<IHHQQQQIIIIHH", size, 2, 0, usn * 10, 5, usn, filetime, reason, 0, 0, 0, len(raw), 60)
    return (head + raw).ljust(size, b"\0")


def usn_rows(journal: bytes | None) -> Iterator[tuple]:
    """usn, name, reason and time of each record of a buffer; a torn tail ends it."""
    at = 0
    while journal and at + 60 <= len(journal):
        size, major, _, _, _, usn, filetime, reason, _, _, _, n, offset = struct.unpack_from("<IHHQQQQIIIIHH", journal, at)
        if size < 60 or at + size > len(journal):
            return
        if major == 2:
            yield usn, journal[at + offset : at + offset + n].decode("utf-16-le", "replace"), reason, datetime(1601, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=filetime // 10)
        at += size


@query("usn_journal_decode", "SELECT o_orderkey::bigint AS usn, 'f' || o_orderkey || '.txt' AS name, case o_orderkey % 16 when 9 then 'delete' when 12 then 'rename' when 13 then 'rename' when 11 then 'permission_change' else 'write' end AS action FROM orders")
def usn_journal_decode(spark, sf_dir):
    """Binary journals of up to 64 records, encoded from all orders and decoded again; each record has one reason
    bit and the one for closing."""

    @F.pandas_udf("binary")
    def encode(k: pd.Series) -> pd.Series:
        t = datetime(2024, 1, 1, tzinfo=timezone.utc)
        return k.map(lambda keys: b"".join(usn_record(f"f{x}.txt", 1 << int(x) % 16 | 0x80000000, int(x), t) for x in keys))

    @F.pandas_udf("array<struct<usn:long,name:string,reason:long>>")
    def decode(j: pd.Series) -> pd.Series:
        return j.map(lambda b: [{"usn": u, "name": n, "reason": r} for u, n, r, _ in usn_rows(b)])

    keys = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 64")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    r = keys.select(encode("k").alias("j")).select(F.explode(decode("j")).alias("r"))
    return r.select("r.usn", "r.name", by_mask(F.col("r.reason"), USN, "write").alias("action"))


def posix_exposure(mode: Column) -> Column:
    return F.when(mode.bitwiseAND(F.lit(4)) != 0, "PUBLIC").when(mode.bitwiseAND(F.lit(32)) != 0, "ORG_WIDE").otherwise("PRIVATE")


@query("posix_exposure", "SELECT p_partkey AS id, case when (p_size * 13 % 512) & 4 <> 0 then 'PUBLIC' when (p_size * 13 % 512) & 32 <> 0 then 'ORG_WIDE' else 'PRIVATE' end AS exposure FROM part")
def posix_exposure_query(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), posix_exposure(F.col("p_size") * 13 % 512).alias("exposure"))


@query("acl_exposure", "SELECT p_partkey AS id, case when p_size % 6 = 0 then 'UNKNOWN' when p_size % 2 = 0 then 'PUBLIC' when p_size % 3 = 0 then 'ORG_WIDE' when p_size % 5 = 0 then 'INTERNAL' else 'PRIVATE' end AS exposure FROM part")
def acl_exposure(spark, sf_dir):
    """Exposure from a descriptor's flags; the widest one counts."""
    s = F.col("p_size")
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (s % 6 != 0).alias("known"), (s % 2 == 0).alias("world"), (s % 3 == 0).alias("authenticated"), (s % 5 == 0).alias("custom"))
    level = F.when(~F.col("known"), "UNKNOWN").when(F.col("world"), "PUBLIC").when(F.col("authenticated"), "ORG_WIDE").when(F.col("custom"), "INTERNAL").otherwise("PRIVATE")
    return d.select("id", level.alias("exposure"))


@query("ocr_text_clean", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g'), ' +', ' ', 'g')) AS h FROM documents")
def ocr_text_clean(spark, sf_dir):
    """Split words that OCR ran together; squeeze blanks."""
    t = F.regexp_replace(F.regexp_replace("text", "([a-z])([A-Z])", "$1 $2"), " +", " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("h"))


@query("enumeration_filter", SQL + "SELECT file_path FROM files WHERE file_size BETWEEN 500 AND 20000 AND NOT file_path LIKE '/src1/%' AND NOT regexp_matches(file_path, '^/src[0-9]*/de/.*7\\.txt$') AND owner <> 'user3'")
def enumeration_filter(spark, sf_dir):
    return enumerate_files(files(spark, sf_dir), least=500, most=20_000, exclude_globs=("/src1/*", "/src*/de/*7.txt"), exclude_owners=("user3",)).select("file_path")


def glob_regex(glob: str) -> str:
    """A shell pattern (*, ?, [abc], [a-z], [!abc]) as a Java regular expression of whole strings. A bracket that nothing closes is a
    character; a range that falls holds none."""
    import re

    out, i = [], 0
    while i < len(glob):
        c, i = glob[i], i + 1
        # a closing bracket that comes first is one of the characters
        end = glob.find("]", i + 1 + glob.startswith("!", i)) if c == "[" else -1
        if end > 0:
            body, i = glob[i:end], end + 1
            no, body = ("^", body[1:]) if body[0] == "!" else ("", body)
            body = re.sub("(.)-(.)", lambda m: m[0] if m[1] <= m[2] else "", body)
            inner = re.sub(r"([\\\[\]&^~|])", r"\\\1", body)
            out.append(f"[{no}{inner}]" if inner else "." if no else "(?!)")
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
    return "(?s)^" + "".join(out) + r"\z"


@query("enumeration_globs", SQL + "SELECT file_path FROM files WHERE NOT file_path GLOB '/src[1-3]/[!e]*' AND NOT file_path GLOB '*[05].txt' AND NOT file_path GLOB '/src1?/[ef][nr]/*'")
def enumeration_globs(spark, sf_dir):
    """Patterns with classes of characters."""
    return enumerate_files(files(spark, sf_dir), exclude_globs=("/src[1-3]/[!e]*", "*[05].txt", "/src1?/[ef][nr]/*")).select("file_path")


TEMP_PRESET = ("*.tmp", "*.temp", "*.swp", "*~", "*.bak", "*.log")
SYSTEM_PRESET = ("/proc/*", "/sys/*", "/dev/*", "*/$Recycle.Bin/*", "*/System Volume Information/*", "*/.git/*", "*/node_modules/*")


def enumerate_files(df: DataFrame, extensions=None, exclude_extensions=(), exclude_globs=(), exclude_owners=(), least=None, most=None, presets: bool = True, path: str = "file_path", size: str = "file_size", owner: str = "owner") -> DataFrame:
    """Files that the enumeration rules let through."""
    p = F.col(path)
    ext = F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1))
    if extensions:
        df = df.where(ext.isin(*extensions))
    if exclude_extensions:
        df = df.where(~ext.isin(*exclude_extensions))
    for g in (*exclude_globs, *((*TEMP_PRESET, *SYSTEM_PRESET) if presets else ())):
        df = df.where(~p.rlike(glob_regex(g)))
    if exclude_owners:
        df = df.where(~F.col(owner).isin(*exclude_owners))
    df = df.where(F.col(size) >= least) if least is not None else df
    return df.where(F.col(size) <= most) if most is not None else df


@query("partition_spec", SQL + "SELECT file_path FROM files WHERE file_path LIKE '/src1%' AND file_path > '/src11' AND file_path < '/src17'")
def partition_spec(spark, sf_dir, prefix="/src1", start_after="/src11", end_before="/src17"):
    p = F.col("file_path")
    return files(spark, sf_dir).where(p.startswith(prefix) & (p > start_after) & (p < end_before)).select("file_path")


@query("reclaim_stuck", "WITH " + JOBS + " SELECT id, case when id % 4 >= 3 then 'failed' else 'pending' end AS new_status, least(2 * pow(2, id % 4), 3600)::double AS backoff FROM jobs WHERE status = 'pending' AND created_at < timestamp '2024-01-15'")
def reclaim_stuck(spark, sf_dir, retries: int = 3):
    """Jobs running for too long: retried with backoff, or failed once their retries are used up."""
    tries = F.col("id") % 4
    stuck = jobs(spark, sf_dir).where((F.col("status") == "pending") & (F.col("created_at") < F.expr("timestamp '2024-01-15'")))
    return stuck.select("id", F.when(tries >= retries, "failed").otherwise("pending").alias("new_status"), F.least(2 * F.pow(F.lit(2.0), tries), F.lit(3600.0)).alias("backoff"))


@query("ttl_cleanup", "WITH " + JOBS + " SELECT status, count(*) AS n FROM jobs WHERE NOT ((status = 'completed' AND created_at < timestamp '1996-01-01' - interval 7 day) OR (status = 'failed' AND created_at < timestamp '1996-01-01' - interval 30 day)) GROUP BY 1")
def ttl_cleanup(spark, sf_dir, now: str = "1996-01-01"):
    old = lambda days: F.col("created_at") < F.expr(f"timestamp '{now}' - interval {days} days")
    return jobs(spark, sf_dir).where(~(((F.col("status") == "completed") & old(7)) | ((F.col("status") == "failed") & old(30)))).groupBy("status").agg(F.count("*").alias("n"))


def next_run(cron: str, after: datetime) -> datetime:
    """The first minute after `after` that a five-field cron expression names."""
    ranges = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))

    def allowed(field: str, lo: int, hi: int) -> set[int]:
        out = set()
        for part in field.split(","):
            span, _, step = part.partition("/")
            a, b = (lo, hi) if span == "*" else (int(span.split("-")[0]), int(span.split("-")[-1]) if "-" in span else (hi if step else int(span)))
            out |= set(range(a, b + 1, int(step or 1)))
        return out

    fields = cron.split()
    minute, hour, day, month, weekday = (allowed(f, *r) for f, r in zip(fields, ranges))
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for _ in range(366 * 24 * 60):
        by_day, by_week = at.day in day, at.isoweekday() % 7 in weekday
        either = by_day or by_week if fields[2] != "*" and fields[4] != "*" else by_day and by_week
        if at.month not in month or not either:
            at = at.replace(hour=0, minute=0) + timedelta(days=1)
        elif at.hour not in hour:
            at = at.replace(minute=0) + timedelta(hours=1)
        elif at.minute in minute:
            return at
        else:
            at += timedelta(minutes=1)
    raise ValueError(f"no time fits {cron}")


@query("schedule_due", "SELECT s_suppkey AS id, (timestamp '2024-01-30 00:00:00' + interval 1 hour * (s_suppkey % 48)) < timestamp '2024-01-31 00:00:00' AS due FROM supplier")
def schedule_due(spark, sf_dir):
    """Schedules (hourly) whose next run after the last one is not after now."""
    @F.pandas_udf("boolean")
    def due(last: pd.Series) -> pd.Series:
        now = datetime(2024, 1, 31)
        return last.map(lambda t: next_run("0 * * * *", t.to_pydatetime().replace(tzinfo=None)) <= now)

    last = F.expr("timestamp '2024-01-30 00:00:00' + make_interval(0, 0, 0, 0, cast(s_suppkey % 48 as int))")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), due(last).alias("due"))


@query("event_list_filter", SQL + "SELECT event_id FROM access WHERE action = 'write' AND user_name ILIKE '%er1%' AND event_time >= timestamp '2024-01-10 00:00:00'")
def event_list_filter(spark, sf_dir, action="write", user="er1", since="2024-01-10 00:00:00"):
    escaped = user.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return access_events(spark, sf_dir).where((F.col("action") == action) & F.col("user_name").ilike(f"%{escaped}%") & (F.col("event_time") >= F.lit(since).cast("timestamp"))).select("event_id")


@query("browse_files", SQL + "SELECT file_name, risk_score FROM scan WHERE file_path LIKE '/src4/%' ORDER BY risk_score DESC, file_name")
def browse_files(spark, sf_dir, folder: str = "/src4"):
    return scan_results(spark, sf_dir).where(F.col("file_path").startswith(folder.rstrip("/") + "/")).orderBy(F.desc("risk_score"), "file_name").select("file_name", "risk_score")


@query("min_score_filter", SQL + "SELECT file_path, risk_score FROM scan WHERE risk_score >= 55")
def min_score_filter(spark, sf_dir):
    return scan_results(spark, sf_dir).where("risk_score >= 55").select("file_path", "risk_score")


@query("page_by_offset", SQL + "SELECT file_path, risk_score, (SELECT count(*) FROM scan) AS total FROM scan ORDER BY risk_score DESC, file_path LIMIT 10 OFFSET 20")
def page_by_offset(spark, sf_dir, page: int = 3, size: int = 10):
    r = scan_results(spark, sf_dir)
    rows = r.orderBy(F.desc("risk_score"), "file_path").offset((page - 1) * size).limit(size).select("file_path", "risk_score")
    return rows.crossJoin(F.broadcast(r.agg(F.count("*").alias("total"))))


@query("page_by_key", SQL + "SELECT scan_date, doc_id FROM scan WHERE (scan_date, doc_id) < (date '2024-01-20', 500) ORDER BY scan_date DESC, doc_id DESC LIMIT 11")
def page_by_key(spark, sf_dir, after=("2024-01-20", 500), size: int = 10):
    """Keyset page: one row more than the page tells whether there is a next one."""
    at = F.struct("scan_date", "doc_id")
    r = scan_results(spark, sf_dir).where(at < F.struct(F.lit(after[0]).cast("date"), F.lit(after[1]).cast("long")))
    return r.orderBy(F.desc("scan_date"), F.desc("doc_id")).limit(size + 1).select("scan_date", "doc_id")


def cursor(values: list, secret: bytes) -> str:
    """An opaque signed cursor of a keyset page."""
    import base64
    import hashlib
    import hmac
    import json

    raw = json.dumps(values).encode()
    return base64.urlsafe_b64encode(hmac.new(secret, raw, hashlib.sha256).digest()[:16] + raw).decode()


def read_cursor(text: str, secret: bytes) -> list:
    import base64
    import hashlib
    import hmac
    import json

    raw = base64.urlsafe_b64decode(text.encode())
    if not hmac.compare_digest(raw[:16], hmac.new(secret, raw[16:], hashlib.sha256).digest()[:16]):
        raise ValueError("the cursor is not ours")
    return json.loads(raw[16:])


@query("rate_limit_window", SQL + "SELECT event_id, count(*) OVER (PARTITION BY user_name ORDER BY epoch(event_time)::bigint RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) > 3 AS limited FROM access")
def rate_limit_window(spark, sf_dir, most: int = 3):
    """Events beyond a user's limit in a sliding minute."""
    a = access_events(spark, sf_dir).withColumn("s", F.unix_timestamp("event_time"))
    w = Window.partitionBy("user_name").orderBy("s").rangeBetween(-60, 0)
    return a.select("event_id", (F.count("*").over(w) > most).alias("limited"))


@query("backpressure_earliest", SQL + "SELECT event_id FROM access ORDER BY event_time, event_id LIMIT 500")
def backpressure_earliest(spark, sf_dir, most: int = 500):
    return access_events(spark, sf_dir).orderBy("event_time", "event_id").limit(most).select("event_id")


@query("last_change_per_path", SQL + "SELECT doc_id, max_by(action, (event_time, event_id)) AS action FROM access GROUP BY 1")
def last_change_per_path(spark, sf_dir):
    return access_events(spark, sf_dir).groupBy("doc_id").agg(F.max_by("action", F.struct("event_time", "event_id")).alias("action"))


@query("valid_actions", SQL + "SELECT action, count(*) AS n FROM access WHERE action IN ('read', 'write', 'delete', 'rename', 'permission_change', 'execute') GROUP BY 1")
def valid_actions(spark, sf_dir):
    return access_events(spark, sf_dir).where(F.col("action").isin("read", "write", "delete", "rename", "permission_change", "execute")).groupBy("action").agg(F.count("*").alias("n"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("redact_audit", "SELECT c_custkey AS id, case when length(c_name) <= 4 then repeat('*', length(c_name)) else left(c_name, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) end AS redacted FROM customer")
def redact_audit(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), redacted(F.col("c_name")).alias("redacted"))


#: Fixed value: values of one file that an audit shows.
AUDITED = 10


def audited(values: Column, kind: str) -> Column:
    """Redacted values for the audit, with their type; the first ones only."""
    return F.slice(F.transform(values, lambda v: F.concat(F.lit(f"{kind}:"), redacted(v))), 1, AUDITED)


@query("redact_matches", rf"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '{EMAIL}') AS v FROM documents)
SELECT doc_id, array_to_string(list_transform(v[1:10], lambda x: 'EMAIL:' || left(x, 2) || repeat('*', length(x) - 4) || right(x, 2)), ',') AS shown, len(v) AS n FROM m WHERE len(v) > 0""")
def redact_matches(spark, sf_dir):
    """What the audit of a file shows of its addresses: ten at most, redacted."""
    found = table(spark, sf_dir, "documents").where(F.col("text").contains("@")).select("doc_id", F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0)).alias("v"))
    return found.where(F.size("v") > 0).select("doc_id", F.array_join(audited(F.col("v"), "EMAIL"), ",").alias("shown"), F.size("v").cast("long").alias("n"))


def redacted(value: Column) -> Column:
    """First and last two characters, stars between."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2))))


@query("serialize_result", "SELECT c_custkey AS id, upper(to_hex(encode(c_name))) AS raw, cast(date '2024-01-01' + cast(c_custkey % 30 as int) AS varchar) AS d FROM customer")
def serialize_result(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.hex(F.encode("c_name", "utf-8")).alias("raw"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 30).cast("int")).cast("string").alias("d"))


# --- formats of the export sinks --------------------------------------------------------------------
CEF_SEVERITY = {"CRITICAL": 10, "HIGH": 7, "MEDIUM": 5, "LOW": 3, "MINIMAL": 1}


def cef_header(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def cef_value(c: Column) -> Column:
    """A value of the extension: backslash, equals sign, bar and line end escaped."""
    for plain, escaped in (("\\", "\\\\"), ("=", "\\="), ("|", "\\|"), ("\n", "\\n")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def severity() -> Column:
    """Severity of a row's tier; the least for a tier that is null or unknown."""
    return F.coalesce(X.literal_map(CEF_SEVERITY)[F.upper("risk_tier")], F.lit(1)).cast("string")


def cef(df: DataFrame) -> Column:
    head = F.concat_ws("|", F.lit("CEF:0"), F.lit("Tessera"), F.lit("Scanner"), F.lit("1.0"), F.lit("scan_result"), cef_header(F.coalesce("risk_tier", F.lit("MINIMAL"))), severity())
    ext = F.concat_ws(" ", F.concat(F.lit("fname="), cef_value(F.col("file_path"))), F.concat(F.lit("cn1="), F.col("risk_score").cast("string")), F.concat(F.lit("cn2="), F.col("total_entities").cast("string")))
    return F.concat(head, F.lit("|"), ext)


def leef(df: DataFrame) -> Column:
    pairs = [F.concat(F.lit(f"{k}="), c) for k, c in (("resource", F.col("file_path")), ("sev", severity()), ("riskScore", F.col("risk_score").cast("string")))]
    return F.concat(F.lit("LEEF:2.0|Tessera|Scanner|1.0|scan_result|"), F.concat_ws("\t", *pairs))


def splunk(df: DataFrame) -> Column:
    return F.to_json(F.struct(F.unix_timestamp(F.col("scan_date").cast("timestamp")).alias("time"), F.lit("tessera:scan").alias("sourcetype"), F.struct("file_path", "risk_score", "risk_tier").alias("event")))


def elastic(df: DataFrame) -> Column:
    """Two lines of a bulk request: the action and the document."""
    action = F.to_json(F.struct(F.struct(F.lit("tessera").alias("_index"), F.sha2("file_path", 256).alias("_id")).alias("index")))
    doc = F.to_json(F.struct(F.date_format("scan_date", "yyyy-MM-dd").alias("@timestamp"), F.struct(F.col("file_path").alias("path")).alias("file"), F.struct(F.col("risk_score").alias("risk_score")).alias("event")))
    return F.concat_ws("\n", action, doc)


def sentinel(df: DataFrame) -> Column:
    return F.to_json(F.struct(F.date_format("scan_date", "yyyy-MM-dd'T'00:00:00'Z'").alias("TimeGenerated"), F.col("file_path").alias("FilePath"), F.col("risk_tier").alias("RiskTier")))


def syslog(df: DataFrame) -> Column:
    """CEF in a syslog frame: facility local0, severity from the tier."""
    level = F.coalesce(X.literal_map({"CRITICAL": 2, "HIGH": 3, "MEDIUM": 4, "LOW": 5, "MINIMAL": 6})[F.col("risk_tier")], F.lit(6))
    return F.concat(F.lit("<"), (F.lit(16 * 8) + level).cast("string"), F.lit(">1 "), F.date_format("scan_date", "yyyy-MM-dd'T'00:00:00'Z'"), F.lit(" tessera scanner - - - "), cef(df))


_SEV = "case risk_tier when 'CRITICAL' then 10 when 'HIGH' then 7 when 'MEDIUM' then 5 when 'LOW' then 3 else 1 end"
_CEF = f"'CEF:0|Tessera|Scanner|1.0|scan_result|' || risk_tier || '|' || {_SEV} || '|fname=' || replace(replace(file_path, chr(92), chr(92) || chr(92)), '=', chr(92) || '=') || ' cn1=' || risk_score || ' cn2=' || total_entities"


@query("export_cef", SQL + f"SELECT doc_id, {_CEF} AS line FROM scan")
def export_cef(spark, sf_dir):
    r = scan_results(spark, sf_dir)
    return r.select("doc_id", cef(r).alias("line"))


_ODD = "(SELECT * REPLACE (file_path || '|a=b' || chr(10) || chr(92) || 'c' AS file_path, case when doc_id % 3 = 0 then NULL else risk_tier end AS risk_tier) FROM scan)"
_VALUE = "file_path"
for _plain, _escaped in (("chr(92)", "chr(92) || chr(92)"), ("'='", "chr(92) || '='"), ("'|'", "chr(92) || '|'"), ("chr(10)", "chr(92) || 'n'")):
    _VALUE = f"replace({_VALUE}, {_plain}, {_escaped})"


@query("export_cef_escaped", SQL + f"SELECT doc_id, 'CEF:0|Tessera|Scanner|1.0|scan_result|' || coalesce(risk_tier, 'MINIMAL') || '|' || {_SEV} || '|fname=' || {_VALUE} || ' cn1=' || risk_score || ' cn2=' || total_entities AS line FROM {_ODD}")
def export_cef_escaped(spark, sf_dir):
    """Paths with every sign that is escaped, and rows without a tier."""
    r = scan_results(spark, sf_dir).withColumn("file_path", F.concat("file_path", F.lit("|a=b\n\\c"))).withColumn("risk_tier", F.when(F.col("doc_id") % 3 != 0, F.col("risk_tier")))
    return r.select("doc_id", cef(r).alias("line"))


@query("export_leef", SQL + f"SELECT doc_id, 'LEEF:2.0|Tessera|Scanner|1.0|scan_result|resource=' || file_path || chr(9) || 'sev=' || {_SEV} || chr(9) || 'riskScore=' || risk_score AS line FROM scan")
def export_leef(spark, sf_dir):
    r = scan_results(spark, sf_dir)
    return r.select("doc_id", leef(r).alias("line"))


@query("export_splunk", SQL + """SELECT doc_id, '{"time":' || epoch(scan_date)::bigint || ',"sourcetype":"tessera:scan","event":{"file_path":"' || file_path || '","risk_score":' || risk_score || ',"risk_tier":"' || risk_tier || '"}}' AS line FROM scan""")
def export_splunk(spark, sf_dir):
    r = scan_results(spark, sf_dir)
    return r.select("doc_id", splunk(r).alias("line"))


@query("export_elastic", SQL + """SELECT doc_id, '{"index":{"_index":"tessera","_id":"' || sha256(file_path) || '"}}' || chr(10) || '{"@timestamp":"' || scan_date || '","file":{"path":"' || file_path || '"},"event":{"risk_score":' || risk_score || '}}' AS line FROM scan""")
def export_elastic(spark, sf_dir):
    r = scan_results(spark, sf_dir)
    return r.select("doc_id", elastic(r).alias("line"))


@query("export_sentinel", SQL + """SELECT doc_id, '{"TimeGenerated":"' || scan_date || 'T00:00:00Z","FilePath":"' || file_path || '","RiskTier":"' || risk_tier || '"}' AS line FROM scan""")
def export_sentinel(spark, sf_dir):
    r = scan_results(spark, sf_dir)
    return r.select("doc_id", sentinel(r).alias("line"))


@query("export_syslog", SQL + f"SELECT doc_id, '<' || (128 + case risk_tier when 'CRITICAL' then 2 when 'HIGH' then 3 when 'MEDIUM' then 4 when 'LOW' then 5 else 6 end) || '>1 ' || scan_date || 'T00:00:00Z tessera scanner - - - ' || {_CEF} AS line FROM scan")
def export_syslog(spark, sf_dir):
    r = scan_results(spark, sf_dir)
    return r.select("doc_id", syslog(r).alias("line"))


@query("export_cursor", SQL + "SELECT 'splunk' AS sink, count(*) AS n, max(scan_date) AS cursor FROM scan WHERE scan_date > date '2024-01-10' UNION ALL SELECT 'elastic', count(*), max(scan_date) FROM scan WHERE scan_date > date '2024-01-20'")
def export_cursor(spark, sf_dir):
    """What each sink gets next and where its cursor moves."""
    cursors = spark.createDataFrame([("splunk", "2024-01-10"), ("elastic", "2024-01-20")], "sink string, at string").withColumn("at", F.col("at").cast("date"))
    r = scan_results(spark, sf_dir).select("scan_date")
    return r.join(F.broadcast(cursors), F.col("scan_date") > F.col("at")).groupBy("sink").agg(F.count("*").alias("n"), F.max("scan_date").alias("cursor"))


@query("report_xml", SQL + "SELECT doc_id, file_path, risk_score FROM scan")
def report_xml(spark, sf_dir):
    """Report rows rendered as XML and read back from it."""
    xml = F.to_xml(F.struct("doc_id", "file_path", "risk_score"), {"rowTag": "r"})
    x = scan_results(spark, sf_dir).select(F.from_xml(xml, "doc_id long, file_path string, risk_score int", {"rowTag": "r"}).alias("x"))
    return x.select("x.*")


@query("report_csv", SQL + "SELECT doc_id, '\"' || file_path || '\",' || risk_score AS line FROM scan")
def report_csv(spark, sf_dir):
    return scan_results(spark, sf_dir).select("doc_id", F.to_csv(F.struct("file_path", "risk_score"), {"quoteAll": "true"}).alias("line")).select("doc_id", F.regexp_replace("line", '"([0-9]+)"$', "$1").alias("line"))


@query("violations_roundtrip", SQL + "SELECT doc_id, (n_card > 0)::int * 2 + (n_email + n_phone + n_ip > 0)::int AS n FROM scan")
def violations_roundtrip(spark, sf_dir):
    """JSON kept in a string column, written and parsed."""
    return with_violations(scan_results(spark, sf_dir)).select("doc_id", F.size(F.from_json("policy_violations", "array<struct<policy_name:string,framework:string,severity:string>>")).alias("n"))
