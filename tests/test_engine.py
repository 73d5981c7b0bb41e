"""Unit tests of what SQL does not say: validators, spans, filters, the guard, policies, triggers, files."""

import random
from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import patterns, validators
from tessera.operators import detect as D
from tessera.plans import adhoc, filters, policy, rows
from tessera.sources import lake
from tessera.streaming import streams


def span(a, b, kind="NAME", conf=0.9, tier=2, name="pattern"):
    return D.Span(a, b, "x" * (b - a), kind, conf, conf, name, tier)


def test_luhn_by_definition():
    assert validators.luhn([int(c) for c in "79927398713"]) and not validators.luhn([int(c) for c in "79927398714"])


@pytest.mark.parametrize("number,valid", [("4111111111111111", 0.99), ("378282246310005", 0.99), ("4111111111111113", 0.87), ("1234567890123", 0.0), ("42", 0.0)])
def test_credit_cards(number, valid):
    assert validators.credit_card(number) == valid


def test_dates():
    assert patterns._is_date("02/30/2024") == 0 and patterns._is_date("30/12/2024") and patterns._is_date("2024-02-29") and not patterns._is_date("1850-01-01")


def test_detection_isolates_and_offsets():
    text = "😀 SSN 123-45-6789 and a.b@x.example.com"
    for s in D.detect_text(text):
        assert text[s.start : s.end] == s.text
    assert {s.entity_type for s in D.detect_text(text)} == {"SSN", "EMAIL"}
    assert D.detect_text("") == D.detect_text(None) == []


def test_machine_learning_band_never_passes():
    assert D.resolve([D.calibrated(span(0, 4, conf=1.0, tier=1))]) == []


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12), st.sampled_from(["NAME", "PERSON", "DATE", "SSN"]), st.sampled_from([0.7, 0.8, 0.9]), st.integers(2, 4)), max_size=10), st.randoms())
def test_resolved_spans_are_disjoint_and_order_free(items, rng):
    spans = [span(a, a + n, k, c, t) for a, n, k, c, t in items]
    got = D.resolve(spans)
    assert all(x.end <= y.start for x, y in zip(got, got[1:]))
    rng.shuffle(spans)
    assert D.resolve(spans) == got


def test_tiered_dedup_keeps_partial_overlaps():
    got = D.dedupe_tiered([span(0, 5), span(3, 8), span(3, 8), span(1, 2)])
    assert [(s.start, s.end) for s in got] == [(0, 5), (3, 8)]


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12), st.integers(2, 4)), max_size=12))
def test_tiered_dedup_equals_all_pairs(items):
    spans = [span(a, a + n, "NAME", 0.8, t) for a, n, t in items]
    places = {(s.start, s.end) for s in spans}
    outer = {p for p in places if not any(q != p and q[0] <= p[0] and p[1] <= q[1] for q in places)}
    assert {(s.start, s.end) for s in D.dedupe_tiered(spans)} == outer and len(D.dedupe_tiered(spans)) == len(outer)


@pytest.mark.parametrize("text, found", [("his 123456789 is", True), ("order 123456789", False), ("Invoice: 123456789", False), ("#123456789", True), ("amino: 123456789", True), ("amino:123456789", False), ("order " + "x" * 40 + " 123456789", True)])
def test_bare_ssn_needs_its_context(text, found):
    got = [s for s in D.detect_text(text, ("pattern",), resolved=False) if s.entity_type == "SSN"]
    assert bool(got) == found


def test_documents_through_the_operators_equal_plain_python(spark):
    text = "Mr. John Smith came. He took his hat; mail a.b@x.example.com and A.B@x.example.com. Patient MRN: 12345678, card 4111 1111 1111 1111."
    d = D.with_spans(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string"), resolved=False)
    d = d.select("doc_id", "text", D.disjoint(F.col("spans")).alias("kept"), D.tiered(F.col("spans")).alias("tiered"))
    d = d.withColumn("coref", D.with_pronouns(F.col("text"), F.col("kept")))
    rows = {r.doc_id: r for r in d.withColumn("entities", D.canonical_entities(F.col("coref"))).collect()}
    raw = D.detect_text(text, resolved=False)
    assert [D.Span(*s) for s in rows[1].tiered] == D.dedupe_tiered(raw)
    assert [D.Span(*s) for s in rows[1].kept] == D.resolve(raw)
    assert [D.Span(*s) for s in rows[1].coref] == D.coreference(text, D.resolve(raw))
    assert [e.asDict() for e in rows[1].entities] == D.resolve_entities(D.coreference(text, D.resolve(raw)))
    assert all(rows[i].kept == rows[i].tiered == rows[i].coref == rows[i].entities == [] for i in (2, 3))


@given(st.text(alphabet="ab ", max_size=300), st.integers(10, 60))
def test_chunks_cover(text, size):
    got = D.chunks(text, size, size // 5)
    assert all(text[a:b] == c and b - a <= size for a, b, c in got)
    assert not text or (got[0][0] == 0 and got[-1][1] == len(text) and all(y[0] <= x[1] for x, y in zip(got, got[1:])))


def test_sentences_and_gender():
    assert D.sentences("Dr. Who came. He left! Why?") == [0, 14, 23]
    assert D.gender("Mary Jones") == "F" and D.gender("Xyz") is None


@pytest.mark.parametrize("bad", ["", "score >", "has(", "has SSN", "(score > 1", "score > 1)", "count(SSN)", "score ! 1", '"open', "and", "score > 1 score < 2", "NOT"])
def test_filter_errors(bad):
    assert filters.validate(bad)


def test_filter_tree():
    assert filters.parse("NOT a = 1 AND b != 'x\\'y' OR count(SSN) >= 2") == filters.Both(
        "OR", filters.Both("AND", filters.Not(filters.Compare("a", "=", 1)), filters.Compare("b", "!=", "x'y")), filters.Call("count", "SSN", ">=", 2))
    assert filters.parse("And = 1") == filters.Compare("And", "=", 1)  # keywords are lower or upper case only


@pytest.mark.parametrize("sql", [
    "DROP TABLE x", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc`", "SELECT java_method('java.lang.System', 'exit')", "WITH a AS (SELECT 1) INSERT INTO b SELECT * FROM a", "SELECT 'delete'", "EXPLAIN SELECT 1",
    "SELECT reflect('a', 'b')", "SELECT * FROM read_files('/x')", "", "SELECT " + "1," * 6000 + "1", "SET a = 1", "SELECT * FROM csv . `/x`", "/* x */ TRUNCATE TABLE y", "SELECT 1 --\n; SELECT 2"])
def test_guard_rejects(sql):
    with pytest.raises(adhoc.Rejected):
        adhoc.validate(sql)


@pytest.mark.parametrize("sql", ["SELECT 1;", "with a as (select 1 as x) select x from a", "SELECT ';' AS semi", "SELECT updated_at FROM t", "(SELECT 1)", "SELECT 1 -- ; comment"])
def test_guard_lets_through(sql):
    assert adhoc.validate(sql)


def test_guarded_fetch(spark):
    got = adhoc.fetch(spark, "SELECT id, $1 AS t, '$1' AS raw FROM range(5)", tenant="a'b", limit=3)
    assert got["truncated"] and len(got["rows"]) == 3 and got["rows"][0] == {"id": 0, "t": "a'b", "raw": "$1"}


def test_policies_from_yaml():
    packs = policy.load_yaml("policies:\n- name: X\n  risk_level: low\n  triggers: {any_of: [email], min_count: 2}\n  retention: {max_days: 3}\n  handling: {masking_required: true, audit_access: false}")
    assert packs[0].trigger.any_of == ("email",) and packs[0].trigger.min_count == 2 and packs[0].max_days == 3 and packs[0].handling == ("masking_required",)
    assert [p.priority for p in policy.in_order()] == sorted((p.priority for p in policy.PACKS), reverse=True)


def test_special_categories(spark):
    from pyspark.sql import functions as F

    d = spark.sql("SELECT map('diagnosis', named_struct('n', 1L, 'c', 0.1D)) AS ctx")
    gdpr = next(p for p in policy.PACKS if p.framework == "gdpr")
    hipaa = next(p for p in policy.PACKS if p.framework == "hipaa")
    assert d.select(policy.violated(F.col("ctx"), gdpr)).first()[0] and not d.select(policy.violated(F.col("ctx"), hipaa)).first()[0]


def test_cron():
    at = datetime(2024, 2, 28, 23, 59)
    assert rows.next_run("0 0 29 2 *", at) == datetime(2024, 2, 29) and rows.next_run("*/15 9-10 * * 1-5", at) == datetime(2024, 2, 29, 9)


def test_cursors_are_signed():
    c = rows.cursor(["2024-01-01", 5], b"k")
    assert rows.read_cursor(c, b"k") == ["2024-01-01", 5]
    with pytest.raises(ValueError):
        rows.read_cursor(c, b"other")


def test_journal_survives_a_torn_tail():
    t = datetime.fromisoformat("2024-01-01T00:00:00+00:00")
    raw = rows.usn_record("é.txt", 0x200, 7, t) + rows.usn_record("b", 1, 8, t)
    assert [(u, n, r) for u, n, r, _ in rows.usn_rows(raw)] == [(7, "é.txt", 0x200), (8, "b", 1)]
    assert len(list(rows.usn_rows(raw[:-3]))) == 1 and next(rows.usn_rows(raw))[3] == t


@pytest.mark.parametrize("family,text", [("PATTERNS", "Jane Smith, DDS"), ("PATTERNS", "at Mercy Health System"), ("PATTERNS", "blood type O+"), ("PATTERNS", "pwd=hunterxx"), ("FINANCIAL", "SWIFT DEUTDEFF"), ("SECRETS", 'token: "abcdefghijklmnop"')])
def test_spans_do_not_hang_on_unrelated_text(family, text):
    """A digit, sign or word elsewhere in the text doesn't decide whether a span is found."""
    family = getattr(patterns, family)
    more = text + " . \n\n 7 @ : phrase _ - = ."
    kept = [(x.start, x.end, x.entity_type) for x in D.family_spans(family, text)]
    assert kept and set(kept) <= {(x.start, x.end, x.entity_type) for x in D.family_spans(family, more)}


def test_cooldown():
    assert streams.cooled([("f", 0.0), ("f", 59.0), ("f", 61.0), ("f", 120.0)]) == [True, False, True, False]


def test_cooldown_of_all_files(spark, tmp_path):
    """Every file passes, and passes again after a minute."""
    from tessera import registry

    rng = random.Random(5)
    events = [(k % 60 + 997 * (k // 60), datetime(2024, 1, 1, 0, rng.randrange(20), rng.randrange(60)), k % 7, "view", 1.0, "{}") for k in range(600)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    from tessera.plans.base import access_events

    by: dict[str, list[float]] = {}
    for r in access_events(spark, str(tmp_path)).selectExpr("doc_id", "cast(floor(unix_micros(event_time) / 1e6) as double) s").collect():
        by.setdefault(str(r.doc_id), []).append(r.s)
    want = []
    for f, times in by.items():
        last = None
        for s in sorted(times):
            if last is None or s - last >= 60:
                last = s
                want.append((f, s))
    got = [(r.file_path, r.sec) for r in registry.queries()["stream_cooldown_all_files"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) > len(by) > 20


def test_text_extraction_never_fails():
    assert lake.extract_text("a.docx", b"not a zip")[1] and lake.extract_text("a.html", b"<p>x<script>y</script>")[0] == "x"
    assert lake.extract_text("a.pdf", b"%PDF")[1] and lake.extract_text("a", None)[1]


def test_file_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("hello")
    (tmp_path / "b.csv").write_text("x,y")
    assert sorted(r.file_name for r in lake.list_files(spark, str(tmp_path)).collect()) == ["a.txt", "b.csv"]
    got = lake.extracted(lake.read_files(spark, str(tmp_path), "*.csv")).collect()
    assert [r.text for r in got] == ["x y"]


def test_storage_options():
    assert lake.storage_options("s3", endpoint="http://x", access_key="a", secret_key="b")["fs.s3a.path.style.access"] == "true"
    with pytest.raises(ValueError):
        lake.storage_options("ftp")


@pytest.mark.parametrize("relation", ["`parquet`.`{}`", "parquet/**/.`{}`", "/* x */ `PARQUET` . `{}`", "parquet.`{}`", "`org.apache.spark.sql.parquet`.`{}`"])
def test_guarded_sql_reads_no_file(spark, relation):
    from tessera.plans import adhoc

    path = "/root/testdata/sf0.001/nation.parquet"
    for sql in (f"SELECT count(*) FROM {relation.format(path)}", f"WITH x AS (SELECT * FROM {relation.format(path)}) SELECT (SELECT max(n_nationkey) FROM x)"):
        with pytest.raises(adhoc.Rejected):
            adhoc.run_guarded(spark, sql).collect()
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_event_values():
    """Every operation and bit of the event sources, and accounts of the system."""
    from tessera.plans import rows

    assert len(rows.OPERATIONS) == 33 and rows.OPERATIONS["FileCopied"] == "read" and rows.OPERATIONS["RemovedFromSecureLink"] == "permission_change"
    assert {"DWM-2", "DWM-3", "UMFD-1"} <= set(rows.SYSTEM_ACCOUNTS) and {"bin", "sys"} <= set(rows.LINUX_ACCOUNTS)
    assert rows.CEF_SEVERITY["HIGH"] == 7


def test_sentences():
    text = 'Dr. Smith met J. Doe. He said "Go!" Then they left? Yes. It cost 3.5 etc. and more.'
    assert [text[a:].split()[0] for a in D.sentences(text)] == ["Dr.", "He", "Then", "Yes.", "It"]
    assert D.sentences("") == [0]


def test_no_span_is_lost_to_what_a_pattern_needs():
    """Whatever a pattern matches has what the pattern is said to need, in any case and with digits of any script."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist() if t]
    texts += [t.upper() for t in texts[:100]] + [t.replace("i", "\u0131").replace("s", "\u017f").replace("k", "\u212a") for t in texts[:100]]
    texts += ["SSN 123-45-6789", "\u0660\u0661\u0662-\u0663\u0664-\u0665\u0666\u0667\u0668", "TOP  SECRET", "pa\u017f\u017fport no. AB1234567", "Jane Smith, DDS"]
    hits = 0
    for text in texts:
        seen = patterns.Seen(text)
        for family in patterns.FAMILIES.values():
            for x in family.patterns:
                if x.regex.search(text):
                    hits += 1
                    assert seen.may_match(x.regex), (x.regex.pattern, text[:80])
    assert hits > 100
    # most patterns need something that can be told before they run
    told = [patterns.needs(x.regex) for family in patterns.FAMILIES.values() for x in family.patterns]
    assert sum(bool(n.literals or n.digits) for n in told) > 0.9 * len(told)


@pytest.mark.parametrize("glob", ["*.txt", "a?c", "[abc]x", "[!abc]x", "[a-c]*", "[]x]y", "[!]x]y", "[ab", "a[", "x[]", "[z-a]", "[!z-a]", "[a&&b]", "[^a]", "a.b+(c)", "[a-]", "[\\\\d]x", "*[0-9][0-9].log"])
def test_globs(glob):
    """As the shell's patterns match, on strings of their own letters."""
    import fnmatch
    import re

    rng = random.Random(glob)
    letters = "abcxyz]![-^&.+()d\\\\09" + glob
    cases = ["", "a.txt", "abc", "cx", "dx", "]y", "xy", "[ab", "a[", "5.log", "x12.log", "line\nend"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    pattern = re.compile(rows.glob_regex(glob)[:-2] + r"\Z")
    assert [bool(pattern.match(c)) for c in cases] == [fnmatch.fnmatchcase(c, glob) for c in cases]
