"""The scan trigger: its folds against a clock that ticks through every moment, and the stream against the folds."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from tessera.streaming import scan_trigger as G
from tessera.streaming import streams as S

SECOND = G.SECOND


def ticked(events, cooldown):
    """A file second by second: what is due goes before an event of the same second."""
    due, open_, quiet = [], None, 0
    for now in range(0, 2000):
        if open_ and open_[2] <= now:
            due.append(tuple(open_))
            quiet, open_ = open_[2] + cooldown, None
        for at, rest in events:
            if at == now and now >= quiet:
                open_ = [open_[0] if open_ else now, now, now + rest, (open_[3] if open_ else 0) + 1]
    return due


def test_bursts_equal_a_clock():
    rng = random.Random(4)
    for _ in range(100):
        events = sorted((rng.randrange(500), rng.choice((2, 5, 30))) for _ in range(rng.randrange(1, 40)))
        done, open_, _ = G.bursts(events, None, 0, 10**6, 60)
        assert done == ticked(events, 60) and open_ is None
        # in two parts, cut anywhere: the state carries on
        cut = rng.randrange(600)
        first, open_, quiet = G.bursts([e for e in events if e[0] <= cut], None, 0, cut, 60)
        second, open_, _ = G.bursts([e for e in events if e[0] > cut], open_, quiet, 10**6, 60)
        assert first + second == done


def test_limit_equals_a_clock():
    rng = random.Random(5)
    for _ in range(60):
        scans = [(d := rng.randrange(60), rng.randrange(3), d, f"f{i}", 1) for i in range(rng.randrange(1, 40))]
        done, left, _ = G.limited(scans, [], 10**6, 4, 20, 5)
        assert not left and sorted(s[3] for s in done) == sorted(s[3] for s in scans)
        waiting, sent, want = list(scans), [], []
        for now in range(3000):
            ready = sorted((s for s in waiting if s[0] == now), key=lambda s: s[1:])
            for s in ready:
                waiting.remove(s)
                if len([t for t in sent if now - t < 20]) < 4:
                    sent.append(now)
                    want.append((*s, now))
                else:
                    waiting.append((now + 5, *s[1:]))
        assert done == want
        half, left, sent = G.limited(scans, [], 30, 4, 20, 5)
        rest, left, _ = G.limited(left, sent, 10**6, 4, 20, 5)
        assert half + rest == done


def test_higher_tiers_go_first():
    done, left, _ = G.limited([(0, 2, 0, "low", 1), (0, 0, 0, "high", 1), (0, 1, 0, "mid", 1)], [], 59 * SECOND, 2, 60 * SECOND, 5 * SECOND)
    assert [s[3] for s in done] == ["high", "mid"] and [w[3] for w in left] == ["low"]


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_with_restarts(spark, tmp_path, parts):
    """Events out of order within the lateness, in files, with the stream started anew for each file."""
    rng = random.Random(6)
    tiers = {f"/f{i}": ("CRITICAL", "HIGH", "MEDIUM", "LOW")[i % 4] for i in range(12)}
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    events = sorted((rng.randrange(900), rng.choice(sorted(tiers))) for _ in range(500))
    size = -(-len(events) // parts)
    pieces = [events[i : i + size] for i in range(0, len(events), size)]
    for a, b in zip(pieces, pieces[1:]):  # neighbours across a cut change places
        if b[0][0] - a[-1][0] < 60:
            a[-1], b[0] = b[0], a[-1]
    own = G.stateful(spark)
    schema = "event_time timestamp, file_path string, risk_tier string"

    def put(rows):
        own.createDataFrame([(start + timedelta(seconds=s), f, tiers.get(f, "MEDIUM")) for s, f in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    for k, piece in enumerate(pieces):
        rng.shuffle(piece)
        put(piece + ([(10**6, "/beat")] if k == len(pieces) - 1 else []))
        stream = S.source(own, str(tmp_path / "in"), schema)
        S.drain(G.scan_trigger(stream, most=3, seconds=60, retry=5), str(tmp_path / "cp"), str(tmp_path / "out"))
    got = sorted((r.file_path, r.risk_tier, r.due, r.dispatched, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    due = []
    for f, tier in tiers.items():
        if tier in G.PRIORITY:
            done, _, _ = G.bursts([(s * SECOND, S.DEBOUNCE[tier] * SECOND) for s, g in events if g == f], None, 0, 10**15, 60 * SECOND)
            due += [(d, G.PRIORITY[tier], d, f, n) for _, _, d, n in done]
    done, _, _ = G.limited(due, [], 10**15, 3, 60 * SECOND, 5 * SECOND)
    when = lambda us: (start + timedelta(microseconds=us)).replace(tzinfo=None)
    assert got == sorted((f, tiers[f], when(d), when(now), n) for _, _, d, f, n, now in done)
    assert any(r[2] != r[3] for r in got)
    assert spark.conf.get(G.STORE, None) != G.ROCKS
