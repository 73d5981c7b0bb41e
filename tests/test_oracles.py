"""Every registered query against its DuckDB SQL on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from tessera import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    rel = duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    place = [rel.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in place) for r in rel.fetchall()), key=str)
    assert ours == theirs


# --- the queries that SQL cannot state, over whole tables, against plain loops ------------------------
@pytest.fixture(scope="module")
def texts(duck):
    return duck.sql("select doc_id, text from documents").fetchall()


def counted(rows):
    from collections import Counter

    return sorted((*k, n) for k, n in Counter(rows).items())


def plainly(name, texts):
    """What a query must give, document by document."""
    from tessera import taxonomy as X
    from tessera.operators import detect as D

    spans = lambda t, **k: D.detect_text(t, **k)
    kind = lambda t: X.ALIASES.get(t.upper(), t.upper())
    if name == "detect_documents":
        rows = [(i, s.detector, kind(s.entity_type)) for i, t in texts for s in spans(t)]
        docs = counted({(f, k, i) for i, f, k in rows})
        return [(f, k, n, len([d for d in docs if d[:2] == (f, k)])) for f, k, n in counted((f, k) for _, f, k in rows)]
    if name == "document_pipeline":
        return sorted((i, min(50, len(s)), tuple(counted((kind(x.entity_type),) for x in s))) for i, t in texts if (s := spans(t)))
    if name == "chunk_counts":
        return counted((i, s.entity_type) for i, t in texts for _, _, c in D.chunks(t or "") for s in spans(c, families=("checksum",)))
    if name == "resolve_documents":
        return sorted((i, len(s), len(D.resolve(s))) for i, t in texts if (s := spans(t, resolved=False)))
    if name == "tiered_documents":
        return sorted((i, len(s := spans(t, resolved=False)), len(D.dedupe_tiered(s))) for i, t in texts)
    if name == "coreference_documents":
        return sorted((i, s.start, s.text, s.entity_type) for i, t in texts for s in D.coreference(t or "", spans(t)) if s.detector == "coref")
    if name == "entities_documents":
        return sorted((i, e["canonical"], e["entity_type"], e["mentions"]) for i, t in texts for e in D.resolve_entities(D.coreference(t or "", spans(t))))
    return counted((s.entity_type,) for _, t in texts for s in spans(t))  # enhanced_documents: whatever their route


COLUMNS = {
    "detect_documents": lambda r: (r.family, r.entity_type, r.n, r.documents), "document_pipeline": lambda r: (r.doc_id, len(r.findings), tuple(sorted(r.entity_counts.items()))),
    "chunk_counts": lambda r: (r.doc_id, r.entity_type, r.n), "resolve_documents": lambda r: (r.doc_id, r.raw, r.kept), "tiered_documents": lambda r: (r.doc_id, r.raw, r.kept),
    "coreference_documents": lambda r: (r.doc_id, r.start, r.value, r.entity_type), "entities_documents": lambda r: (r.doc_id, r.canonical, r.entity_type, r.mentions),
}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_equals_plain_loops(spark, texts, name):
    rows = registry.queries()[name](spark, str(DATA)).collect()
    if name == "enhanced_documents":
        from collections import Counter

        total = Counter()
        for r in rows:
            total[r.entity_type] += r.n
        assert sorted(total.items()) == plainly(name, texts)
    else:
        assert sorted(map(COLUMNS[name], rows)) == plainly(name, texts)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_anomalies_are_all_listed(spark, tmp_path):
    """Just over the numbers and just not, without a user's name, and more than a hundred of each kind."""
    failures = [(v + 997 * k, 1000 + v, "error") for v in range(160) for k in range(1 if v % 4 == 0 else 2)]
    users = [(u, 70 + u % 2) for u in range(240)] + [(None, 71)]
    views = [(10_000 + i, u, "view") for i, u in enumerate(u for u, n in users for _ in range(n))]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame([(i, datetime.datetime(2024, 1, 1), u, kind, 1.0, "{}") for i, u, kind in failures + views], schema).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = [("high_volume", None if u is None else f"user{u}", None, n) for u, n in users if n > 70] + [("failed_access", f"user{1000 + v}", v, 2) for v in range(160) if v % 4]
    ours = [(r.kind, r.user_name, r.doc_id, r.n) for r in registry.queries()["anomalies"](spark, str(tmp_path)).collect()]
    theirs = c.sql(f"select kind, user_name, doc_id, n from ({registry.oracle_sql()['anomalies']})").fetchall()
    assert sorted(ours, key=str) == sorted(theirs, key=str) == sorted(want, key=str)
