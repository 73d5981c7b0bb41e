"""N-gram Jaccard join by a universe-partition pigeonhole.

A document's set is its distinct shingles of SHINGLE words. Sizes are dealt into bands. For pairs whose
larger set lies in a band, similarity >= THRESHOLD % bounds the symmetric difference by H; the universe of
shingles is hashed into m = H + 1 + slack segments, so at least 1 + slack segments of such a pair agree.
A set's part in a segment, hashed with the segment's number, is a key under which it is indexed.

Cost-based allocation. A segment is weak where its part is empty or holds only frequent shingles (a
bounded list of heavy hitters of the corpus): its key would be shared by unrelated documents. With at most
`slack` weak segments a set leaves them out (cost 0) and indexes the rest exactly (cost 1). With more, it
also indexes the one-deletion neighbourhoods of the segments that have two or more rare shingles (cost 2),
as long as the allocations sum to H + 1. Where they don't (sets that are mostly frequent, such as the
members of a large group of near copies, or a short text around a passage that thousands share), the pigeonhole
would need keys that are hot; two such sets meet in the rarest (100 - THRESHOLD) % + 1 of their shingles
instead, one of which similar sets must share. Any pair of similar sets shares a key under every combination of
these choices, so no list of heavy hitters can lose a pair.

Keys shared by several sets give candidates in two rounds. First every set is paired with the least one of
its key (a number linear in the keys); the proven links make components. Then, in keys where components still
meet, sets are compared across components inside tasks: a similar pair agrees in 1 + slack segments of its
scheme, so it shares at least 1 + slack - w keys there, w being the weak segments of either set; a set with
fewer open keys is done, and of K open keys it needs to meet others in its K - need + 1 rarest only (two sets
that share `need` keys share one of those); keys with the same least set are joined. A key's sets are dealt into blocks of bounded size, and each pair of
blocks is one tile; the sets of the component that holds most of a key meet those of the others only. A tile
counts the shingles in common of all its pairs and hands on a spanning forest of the links it finds, so neither
pairs nor links are ever rows. Sets with equal content are one class from the start.

Shingles are 64-bit fingerprints. A class is known by 64 bits as well, but every row has a second, independent
fingerprint: classes whose rows disagree there are found by one aggregation and are known by the second one,
so different sets are one class only if 128 bits agree.

Nulls and edge cases: null, empty and wordless texts have size 0 and are their own component; texts with
fewer words than a shingle have one shingle, the whole sequence; rows with a null id take part, their id
never names a component; repeated rows each get their row; extra columns change nothing; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.components import components
from tessera.llm.shared import buckets, cut, hot_keys, salted_join, stored, table, text_chunks

SHINGLE = 5
THRESHOLD = 80
#: Ratio of a band's largest to its smallest size.
BAND = 1.5
#: Heavy hitters: kept at most, and the least number of sets that hold one.
HEAVY = 1 << 16
HEAVY_COUNT = 48
#: Bits of the filter that spares sets without candidates the shuffle; a full filter only costs time.
FILTER_BITS = 1 << 25
#: Signatures that a task holds before it hands them on, and that a bucket of the index has on average.
FLUSH = 500_000
BUCKET = 250_000
#: Buckets that signatures are dealt to at once; more are dealt in two levels, so that what is handed on stays large.
FAN = 2048
#: Sets and shingles of a block; a tile is two blocks.
TILE_ROWS = 512
#: Keys of more sets are never joined with others.
JOINED = 4096
TILE_SHINGLES = 500_000

#: Classes that a task remembers to skip their copies; those it forgets are merged after the shuffle.
SEEN = 200_000

#: Weak segments are told apart up to here.
FEW = 32_767

U = np.uint64
#: Bits of a first fingerprint; tests leave few, so that sets collide.
BITS = 64


class Bands:
    """Size bands and their numbers of segments."""

    def __init__(self, threshold: int = THRESHOLD, ratio: float = BAND, top: int = 1 << 40):
        self.threshold = threshold
        lo, his = 1, []
        los = []
        while lo < top:
            hi = max(lo, int(lo * ratio) - 1)
            los.append(lo), his.append(hi)
            lo = hi + 1
        self.lo, self.hi = np.array(los, np.int64), np.array(his, np.int64)
        self.h = 2 * self.hi * (100 - threshold) // (100 + threshold)
        self.slack = 3 + self.h // 6
        self.m = self.h + 1 + self.slack

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.hi, n, "left")


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted by row: fingerprints and rows."""
    buf = K.LOWER[buf]
    starts, ends, rows = K.word_spans(buf, offsets, K.NOT_SPACE)
    hashes = K.span_hash(K.rolling(buf), starts, ends)
    g, first = K.runs(hashes, rows, n)
    g, row = K.mix(g ^ U(n)), rows[first]
    words = np.bincount(rows, minlength=len(offsets) - 1)
    for k in range(1, n):  # shorter texts
        if (words == k).any():
            s, at = K.runs(hashes, rows, k)
            short = words[rows[at]] == k
            g, row = np.concatenate([g, K.mix(s[short] ^ U(k))]), np.concatenate([row, rows[at[short]]])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[fresh], row[fresh]


def classes(g: np.ndarray, row: np.ndarray, n_rows: int, twice: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's set size, its class, and its second fingerprint. twice: first fingerprints (sorted) that several
    sets have; such sets are known by the second one."""
    size = np.bincount(row, minlength=n_rows)
    sizes = K.mix(size.astype(U))
    cls = K.mix(_sums(K.mix(g + U(7)), row, n_rows) ^ sizes) >> U(64 - bits)
    with np.errstate(over="ignore"):
        other = K.mix(_sums(K.mix(g ^ U(0x3C6EF372FE94F82B)), row, n_rows) + sizes)
    if len(twice):
        cls = np.where(twice[np.minimum(np.searchsorted(twice, cls), len(twice) - 1)] == cls, other, cls)
    return size, cls, other


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 by group."""
    low = np.bincount(group, (values & U(0xFFFFFFFF)).astype(np.float64), n).astype(U)
    high = np.bincount(group, (values >> U(32)).astype(np.float64), n).astype(U)
    with np.errstate(over="ignore"):
        return low + (high << U(32))


def signatures(g: np.ndarray, row: np.ndarray, size: np.ndarray, bands: Bands, heavy: np.ndarray, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and the rows they index, for rows whose set can be similar to another one; for each key the row's
    weak segments in the scheme of its own band and of the next (FEW at most), or FEW + 1 where the key is a
    shingle; and whether the key is a heavy shingle. A key's lowest bit is its scheme's.
    heavy: frequent shingles, sorted; often: their counts."""
    weaks = np.zeros((2, len(size)), np.uint16)
    x = K.mix(g ^ U(0x51ED270B))
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, g), len(heavy) - 1)
        rare = heavy[at] != g
        count_of = np.where(rare, 0, (np.ones(len(heavy), np.int64) if often is None else often)[at])
    else:
        rare, count_of = np.ones(len(g), bool), np.zeros(len(g), np.int64)
    keys, owners, marks = [], [], []
    own = bands.of(np.maximum(size, 1))
    for up in range(2):
        scheme = np.minimum(own + up, len(bands.lo) - 1)
        # own band, and the next one if a larger partner may come from it (BAND is above 100 / THRESHOLD)
        fits = 100 * size >= bands.threshold * bands.lo[scheme] if up else size > 0
        # a smaller set than this is similar only to an equal one
        fits = fits & (100 * size >= bands.threshold * (size + 1))
        if not fits.any():
            if up:
                break
            continue
        m = np.where(fits, bands.m[scheme], 0)
        base = np.concatenate([[0], np.cumsum(m)])
        total = int(base[-1])
        use = fits[row]
        r, xs, rs = row[use], x[use], rare[use]
        seg = (((K.mix(xs) >> U(32)) * m[r].astype(U)) >> U(32)).astype(np.int64)
        gid = base[r] + seg
        sums = _sums(xs, gid, total)
        rares = np.bincount(gid[rs], minlength=total)
        owner = np.repeat(np.arange(len(size)), m)
        number = np.arange(total) - base[owner]
        salt = K.mix((scheme[owner].astype(U) << U(40)) + number.astype(U) + U(1))
        per = lambda flags: np.bincount(owner[flags], minlength=len(size))
        weak, strong = per(rares == 0), per(rares >= 2)
        slack, h = bands.slack[scheme], bands.h[scheme]
        weaks[up] = np.minimum(weak, FEW)
        plain = weak <= slack
        parity = (scheme & 1).astype(U)
        spread = ~plain & (2 * strong + (m - weak - strong) >= h + 1)
        whole = ~plain & ~spread
        emit = rares > 0
        with np.errstate(over="ignore"):
            keys.append(K.mix(sums[emit] ^ salt[emit]) & ~U(1) | parity[owner[emit]])
            owners.append(owner[emit])
            drop = (~plain[r]) & (rares[gid] >= 2)
            if drop.any():
                keys.append(K.mix((sums[gid[drop]] - xs[drop]) ^ salt[gid[drop]]) & ~U(1) | parity[r[drop]])
                owners.append(r[drop])
            if whole.any():
                some = np.flatnonzero(whole[r])
                order = some[np.lexsort((g[use][some], count_of[use][some], r[some]))]
                place = np.arange(len(order)) - np.searchsorted(r[order], r[order])
                first = order[place < (size - -(-bands.threshold * size // 100) + 1)[r[order]]]
                keys.append(K.mix(xs[first] ^ K.mix(scheme[r[first]].astype(U) ^ U(0xA24BAED4963EE407))) & ~U(1) | parity[r[first]])
                owners.append(r[first])
                marks.append((sum(map(len, owners[:-1])), ~rare[use][first]))
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros((2, 0), np.uint16), np.zeros(0, bool)
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    weaks, hot = weaks[:, owners], np.zeros(len(keys), bool)
    for begin, known in marks:
        weaks[:, begin : begin + len(known)] = FEW + 1
        hot[begin : begin + len(known)] = known
    return keys, owners, weaks, hot


def _base(docs: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    """k, n, cls and second fingerprint (c) for each row; and, marked by n = -1, heavy shingles (cls) with their
    counts (c) by task."""
    kind = docs.schema[key].dataType
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", kind), T.StructField("n", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("c", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, count = np.zeros(0, U), np.zeros(0, np.int64)
        arrow = None
        for batch in batches:
            arrow = batch.schema.field(0).type
            for a, b, buf, offsets in text_chunks(batch.column(1)):
                g, row = shingle_sets(buf, offsets)
                size, cls, other = classes(g, row, b - a, np.zeros(0, U), bits)
                # a heavy shingle is counted once for each set that the task meets
                new = np.zeros(b - a, bool)
                for i, c in enumerate(cls.tolist()):
                    if c not in seen:
                        seen.add(c)
                        new[i] = True
                u, c = np.unique(g[new[row]], return_counts=True)
                held, inverse = np.unique(np.concatenate([held, u]), return_inverse=True)
                count = np.bincount(inverse, np.concatenate([count, c]), len(held)).astype(np.int64)
                if len(held) > 2 * HEAVY:
                    keep = np.sort(np.argpartition(-count, HEAVY)[:HEAVY])
                    held, count = held[keep], count[keep]
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(cls.view(np.int64)), pa.array(other.view(np.int64))], names=["k", "n", "cls", "c"])
        if arrow is not None:
            often = count >= 3
            held, count = held[often], count[often]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(held), arrow), pa.array(np.full(len(held), -1)), pa.array(held.astype(np.int64)), pa.array(count)], names=["k", "n", "cls", "c"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)


def _deal(key, cls, n, w0, w1, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each value of b: its signatures, packed. Runs of one set's keys tell of it once."""
    order = np.argsort(b.astype(np.int16) if b.max() < 1 << 15 and b.min() >= 0 else b, kind="stable")
    key, cls, n, w0, w1, b = key[order], cls[order], n[order], w0[order], w1[order], b[order]
    low = key.view(np.uint8).reshape(-1, 8)
    edges = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        s = slice(begin, end)
        c = cls[s]
        turn = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (w0[s][1:] != w0[s][:-1]) | (w1[s][1:] != w1[s][:-1])]))
        times = np.diff(np.append(turn, len(c)))
        if times.max() > 255:  # a run's length is one byte
            turn = np.unique(np.concatenate([turn, *(np.arange(t, t + k, 255) for t, k in zip(turn[times > 255], times[times > 255]))]))
            times = np.diff(np.append(turn, len(c)))
        at = int(b[begin])
        # a bucket stands for the key's upper bytes; a hot key keeps all
        packed = low[s].tobytes() if at < 0 else np.ascontiguousarray(low[s][:, :6]).tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([at]), pa.array([c[turn].tobytes()], pa.binary()), pa.array([n[s][turn].astype(np.uint32).tobytes()], pa.binary()), pa.array([w0[s][turn].tobytes()], pa.binary()), pa.array([w1[s][turn].tobytes()], pa.binary()), pa.array([times.astype(np.uint8).tobytes()], pa.binary()), pa.array([packed], pa.binary())],
            names=["b", "cls", "n", "w0", "w1", "times", "keys"],
        )


def _packed(row: list, width: int) -> tuple[np.ndarray, ...]:
    """Keys, and the classes, sizes and weak segments (both schemes) of the runs, with each key's run."""
    _, cls, n, w0, w1, times, keys = row
    times = np.frombuffer(times, np.uint8)
    raw = np.frombuffer(keys, np.uint8).reshape(-1, width)
    key = np.zeros((len(raw), 8), np.uint8)
    key[:, :width] = raw
    return key.view(U).ravel(), np.frombuffer(cls, U), np.frombuffer(n, np.uint32).astype(np.int64), np.frombuffer(w0, np.uint16), np.frombuffer(w1, np.uint16), np.repeat(np.arange(len(times)), times)


def _member(key: np.ndarray, cls: np.ndarray, n: np.ndarray, w0: np.ndarray, w1: np.ndarray, bands: Bands) -> dict[str, np.ndarray]:
    """What a member of a key is told by."""
    band = bands.of(n)
    other = ((key ^ band.astype(U)) & U(1)).astype(bool)
    scheme = band + other
    w = np.where(other, w1, w0).astype(np.int64)
    need = np.where(w >= FEW, 1, np.maximum(1, 1 + bands.slack[scheme] - w))
    return {"key": key.view(np.int64), "cls": cls.view(np.int64), "n": n, "band": band, "scheme": scheme, "need": need}


MEMBER = "key long, cls long, n long, band long, scheme long, need long"
SIGNATURES = "b long, cls binary, n binary, w0 binary, w1 binary, times binary, keys binary"


def _members(docs: DataFrame, text: str, bands: Bands, heavy: np.ndarray, often: np.ndarray, twice: np.ndarray, bits: int, n_buckets: int) -> tuple[DataFrame, DataFrame]:
    """The members of keys of several classes (key, cls, n, its band, the key's scheme, and need: the keys that a
    similar pair shares at least), and the pairs (centre, cls, need) of each class with the key's least one, where
    they can be similar by size.

    Keys that are heavy shingles, known to be frequent, never meet in one task; the others are as rare as their
    rarest shingle, and meet in buckets.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((heavy, often, twice))
    threshold, levels = bands.threshold, 1 if n_buckets <= FAN else 2

    def bucket(key: np.ndarray, n: int) -> np.ndarray:
        return (((key >> U(32)) * U(n)) >> U(32)).astype(np.int64)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n_held = 0
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            key, cls, n, w0, w1, hot = (np.concatenate(x) for x in zip(*held))
            # one of the first level's buckets is a range of the second's
            b = bucket(key, n_buckets) if levels == 1 else bucket(key, n_buckets) * FAN // n_buckets
            # hot keys go as they are, a flush's to one bucket
            yield from _deal(key, cls, n, w0, w1, np.where(hot, -1 - (K.mix(key[:1] ^ cls[-1:]) >> U(2)).astype(np.int64), b))

        for batch in batches:
            for a, z, buf, offsets in text_chunks(batch.column(0)):
                g, row = shingle_sets(buf, offsets)
                size, cls, _ = classes(g, row, z - a, shared.value[2], bits)
                new = np.zeros(z - a, bool)
                for i, c in enumerate(cls.tolist()):
                    if c not in seen:
                        seen.add(c)
                        new[i] = True
                if len(seen) > SEEN:
                    seen.clear()
                keep = new[row]
                key, owner, weak, hot = signatures(g[keep], row[keep], np.where(new, size, 0), bands, *shared.value[:2])
                order = np.argsort(owner, kind="stable")
                key, owner, weak, hot = key[order], owner[order], weak[:, order], hot[order]
                held.append((key, cls[owner], size[owner], weak[0], weak[1], hot))
                n_held += len(key)
                if n_held >= FLUSH:
                    yield from flush()
                    held.clear()
                    n_held = 0
        if n_held:
            yield from flush()

    def deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([v], c.type) for v, c in zip(row, batch.columns)], names=batch.schema.names)
                    continue
                first = -(-row[0] * n_buckets // FAN)  # the least bucket of this range
                key, cls, n, w0, w1, run = _packed(row, 6)
                # the upper bytes are gone, the bucket within the range is dealt by the lower ones
                width = max(1, -(-(row[0] + 1) * n_buckets // FAN) - first)
                b = first + (K.mix(key) % U(width)).astype(np.int64)
                held.append((key, cls[run], n[run], w0[run], w1[run], b))
                n_held += len(key)
                if n_held >= FLUSH:
                    yield from _deal(*(np.concatenate(x) for x in zip(*held)))
                    held, n_held = [], 0
        if n_held:
            yield from _deal(*(np.concatenate(x) for x in zip(*held)))

    def meet(t: pa.Table) -> pa.Table:
        if len(t) and t.column("b")[0].as_py() < 0:
            parts = [_member(key, cls[run], n[run], w0[run], w1[run], bands) for key, cls, n, w0, w1, run in (_packed(row, 8) for row in zip(*(c.to_pylist() for c in t.columns)))]
            m = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
            none = np.zeros(len(m["key"]), bool)
            return pa.table(m | {"centre": m["cls"], "star": none, "star_need": m["need"], "hot": ~none})
        parts = [_packed(row, 6) for row in zip(*(c.to_pylist() for c in t.columns))]
        runs = np.cumsum([0, *(len(p[1]) for p in parts)])
        key, run = np.concatenate([p[0] for p in parts]), np.concatenate([p[5] + at for p, at in zip(parts, runs)])
        cls, n, w0, w1 = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
        del parts
        some = np.flatnonzero(K.repeated(key))
        key, run = key[some], run[some]
        order = np.lexsort((cls[run], key))
        key, run = key[order], run[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (cls[run][1:] != cls[run][:-1])
        key, run = key[fresh], run[fresh]
        m = _member(key, cls[run], n[run], w0[run], w1[run], bands)
        n, band, scheme = m["n"], m["band"], m["scheme"]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        length = np.diff(np.append(first, len(key)))
        begin, length = np.repeat(first, length), np.repeat(length, length)
        star = (100 * np.minimum(n, n[begin]) >= threshold * np.maximum(n, n[begin])) & (scheme == np.maximum(band, band[begin]))
        # of a key of two, both go if they can't be similar by size or meet in another scheme
        keep = (length > 2) | (length == 2) & np.where(begin == np.arange(len(key)), np.append(star[1:], False), star)
        number = (t.column("b")[0].as_py() << 48) if len(t) else 0  # tells the buckets apart
        m["key"] = (key + U(number % (1 << 63))).view(np.int64)
        at = np.flatnonzero(keep)
        m |= {"centre": m["cls"][begin], "star": star & (begin != np.arange(len(key))), "star_need": np.maximum(m["need"], m["need"][begin])}
        return pa.table({c: v[at] for c, v in m.items()} | {"hot": np.zeros(len(at), bool)})

    dealt = docs.select(F.col(text).alias("t")).mapInArrow(index, SIGNATURES)
    if levels == 2:
        dealt = dealt.repartition(buckets(spark), "b").mapInArrow(deal_again, SIGNATURES)
    met = stored(dealt.groupBy("b").applyInArrow(meet, f"{MEMBER}, centre long, star boolean, star_need long, hot boolean"), "members")
    rare = met.where("not hot")
    pairs = rare.where("star").select("centre", "cls", F.col("star_need").alias("need"))
    columns = ["key", "cls", "n", "band", "scheme", "need"]
    if not len(heavy):
        return rare.select(columns), pairs
    frequent = stored(met.where("hot").select(columns).dropDuplicates(["key", "cls"]), "frequent")
    # a row for each heavy shingle and scheme, 2 * HEAVY at most
    centres = frequent.groupBy("key").agg(F.min_by(F.struct("cls", "n", "band"), "cls").alias("c")).select("key", F.col("c.cls").alias("centre"), F.col("c.n").alias("m"), F.col("c.band").alias("other"))
    hot_pairs = frequent.join(F.broadcast(centres), "key").where("cls <> centre").where(f"100 * least(n, m) >= {threshold} * greatest(n, m) and scheme = greatest(band, other)")
    return rare.select(columns).unionByName(frequent.select(columns)), pairs.unionByName(hot_pairs.select("centre", "cls", "need"))


def _filter(needed: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS with a bit for each needed class (column cls); its size is fixed."""
    parts, width = 64, FILTER_BITS // 64

    def run(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_slot(batch.column(0).to_numpy(zero_copy_only=False).view(U))] = True
        for i in range(parts):
            part = bits[i * width : (i + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([np.packbits(part).tobytes()], pa.binary())], names=["i", "m"])

    def both(t: pa.Table) -> pa.Table:
        m = np.zeros(width // 8, np.uint8)
        for x in t.column("m"):
            m |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"i": t.column("i")[:1], "m": pa.array([m.tobytes()], pa.binary())})

    out = np.zeros((parts, width // 8), np.uint8)
    for r in needed.select("cls").mapInArrow(run, "i long, m binary").groupBy("i").applyInArrow(both, "i long, m binary").toLocalIterator():
        out[r.i] = np.frombuffer(bytes(r.m), np.uint8)
    return out.ravel()


def _slot(cls: np.ndarray) -> np.ndarray:
    return (K.mix(cls) & U(FILTER_BITS - 1)).astype(np.int64)


def _sets(docs: DataFrame, text: str, needed: DataFrame, twice: np.ndarray, bits: int) -> DataFrame:
    """cls and its shingles (sorted 64-bit fingerprints), one row for each needed class."""
    shared = docs.sparkSession.sparkContext.broadcast((_filter(needed), twice))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for a, b, buf, offsets in text_chunks(batch.column(0)):
                g, row = shingle_sets(buf, offsets)
                size, cls, _ = classes(g, row, b - a, shared.value[1], bits)
                slot = _slot(cls)
                wanted = (shared.value[0][slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1
                edges = np.concatenate([[0], np.cumsum(size)])
                ids, sets = [], []
                for i in np.flatnonzero(wanted & (size > 0)).tolist():
                    c = int(cls[i])
                    if c not in seen:
                        seen.add(c)
                        ids.append(c)
                        sets.append(g[edges[i] : edges[i + 1]].tobytes())
                if len(seen) > SEEN:
                    seen.clear()
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, U).view(np.int64)), pa.array(sets, pa.binary())], names=["cls", "s"])

    got = docs.select(F.col(text).alias("t")).mapInArrow(run, "cls long, s binary")
    return got.join(needed, "cls", "left_semi").dropDuplicates(["cls"])


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (centre, cls) whose sets are similar enough. A centre with many partners is dealt to several tasks."""
    counts = pairs.groupBy("centre").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, "centre", "n", pairs.count())
    dealt = pairs.withColumn("__salts", F.lit(1)) if hot is None else pairs.join(F.broadcast(hot), "centre", "left")
    dealt = dealt.select("centre", "cls", F.pmod(F.xxhash64("cls"), F.coalesce("__salts", F.lit(1))).alias("deal"))
    theirs = dealt.join(sets, "cls").select("centre", "deal", F.lit(1).alias("part"), "cls", "s")
    own = dealt.select("centre", "deal").distinct().join(sets.withColumnRenamed("cls", "centre"), "centre").select("centre", "deal", F.lit(0).alias("part"), F.col("centre").alias("cls"), "s")
    # the centre's row comes first
    rows = own.unionByName(theirs).repartition(buckets(pairs.sparkSession), "centre", "deal").sortWithinPartitions("centre", "deal", "part")

    def run(batches):
        centre, own_set = None, np.zeros(0, U)
        for batch in batches:
            a, part, b, s = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            left, right = [], []
            for i in range(len(a)):
                x = np.frombuffer(s[i].as_buffer(), U)
                if part[i] == 0:
                    centre, own_set = a[i], x.copy()
                elif a[i] == centre:
                    small, large = (x, own_set) if len(x) < len(own_set) else (own_set, x)
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    common = int((large[at] == small).sum())
                    if 100 * common >= threshold * (len(x) + len(own_set) - common):
                        left.append(centre), right.append(b[i])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def tile_links(sets: list[np.ndarray], root: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different roots: pairs of places."""
    n = np.array([len(s) for s in sets])
    _, values = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    # only what several sets hold counts
    shared = np.bincount(values)[values] > 1
    values, owner = values[shared], owner[shared]
    _, values = np.unique(values, return_inverse=True)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048  # shingles at a time
    for low in range(0, int(values[-1]) + 1 if len(values) else 0, width):
        a, b = np.searchsorted(values, [low, low + width])
        part = np.zeros((len(sets), min(width, int(values[-1]) + 1 - low)), np.float32)
        part[owner[a:b], values[a:b] - low] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    link = (100 * common >= threshold * (n[:, None] + n[None, :] - common)) & (root[:, None] != root[None, :])
    out, new = [], np.ones(len(sets), bool)
    for start in np.flatnonzero(link.any(1)).tolist():
        if not new[start]:
            continue
        new[start], front = False, [start]
        while front:
            u = front.pop()
            found = np.flatnonzero(link[u] & new).tolist()
            new[found] = False
            out += [(u, v) for v in found]
            front += found
    return out


def _open_keys(members: DataFrame, roots: DataFrame, threshold: int) -> DataFrame:
    """key, cls, n, root: for each set the keys in which it still has to meet others, in keys that hold several
    components. Keys of up to JOINED sets whose least set is the same are joined to one: near copies share many keys,
    each of which holds most of them, and so meet once."""
    from pyspark.sql import Window

    placed = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    at_keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("key", "c")
    opened = salted_join(placed, at_keys, "key", hot_keys(at_keys, "key", "c", members.count()), F.col("cls"))
    # the rarest keys of a set and scheme, as many as it needs; a set's keys are as many as its shingles
    of_set = Window.partitionBy("cls", "scheme")
    ranked = opened.withColumn("k", F.count("*").over(of_set)).withColumn("nth", F.row_number().over(of_set.orderBy("c", "key")))
    ranked = cut(ranked.where("nth <= k - need + 1").select("key", "cls", "n", "root"))
    left = ranked.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("c"), F.min("cls").alias("first"))
    left = left.where(f"lo <> hi and (c > 2 or 100 * least >= {threshold} * most)").select("key", "c", F.when(F.col("c") <= JOINED, F.col("first")).otherwise(F.col("key")).alias("joined"))
    joined = salted_join(ranked, left, "key", hot_keys(left, "key", "c", ranked.count()), F.col("cls"))
    return joined.select(F.col("joined").alias("key"), "cls", "n", "root").distinct()


def _tiles(opened: DataFrame) -> DataFrame:
    """key, i, j, cls, root: each set once for each tile that it is in."""
    sizes = opened.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = lambda c, s: F.ceil(F.greatest(c / F.lit(TILE_ROWS), s / F.lit(TILE_SHINGLES))).cast("int")
    keys = sizes.groupBy("key").agg(F.max_by(F.struct("root", "c", "s"), F.struct("c", "root")).alias("most"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    # blocks of the component with most sets of the key, and of the others
    keys = keys.select("key", "c", F.col("most.root").alias("main"), blocks(F.col("most.c"), F.col("most.s")).alias("mains"), blocks(F.col("c") - F.col("most.c"), F.col("s") - F.col("most.s")).alias("others"))
    placed = salted_join(opened, keys.drop("c"), "key", hot_keys(keys, "key", "c", opened.count()), F.col("cls"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cls"), F.when(F.col("root") == F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    # tile (i, j): i a block of the main component (from 0 on) or of the others (below 0), j one of the others
    of_main = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
    across = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    among = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct((-1 - F.least(j, F.col("block"))).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    # a single block of others meets itself in its tiles with the main one
    others = F.when(F.col("others") == 1, across).otherwise(F.concat(across, among))
    tile = F.explode(F.when(F.col("root") == F.col("main"), of_main).otherwise(others)).alias("t")
    return placed.select("key", "cls", "root", tile).select("key", "t.i", "t.j", "cls", "root")


def _across(tiles: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v: roots) between components, found in tiles."""
    rows = tiles.join(sets, "cls").repartition(buckets(tiles.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        tile, sets, roots = None, [], []

        def found():
            root = np.array(roots, np.int64)
            links = tile_links(sets, root, threshold)
            if links:
                at = np.array(links)
                yield pa.RecordBatch.from_arrays([pa.array(root[at[:, 0]]), pa.array(root[at[:, 1]])], names=["u", "v"])

        for batch in batches:
            ids = list(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "root"))))
            column = batch.column("s")
            for at, (*now, root) in enumerate(ids):
                if now != tile:
                    if len(sets) > 1:
                        yield from found()
                    tile, sets, roots = now, [], []
                sets.append(np.frombuffer(column[at].as_buffer(), U).copy())
                roots.append(root)
        if len(sets) > 1:
            yield from found()

    return rows.mapInArrow(run, "u long, v long")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, bits: int = BITS) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (the least key that links reach)."""
    bands = Bands(threshold)
    marked = cut(_base(docs, key, text, bits))
    base = marked.where("n >= 0")
    heavy = marked.where("n = -1").groupBy("cls").agg(F.sum("c").alias("c")).where(F.col("c") >= HEAVY_COUNT)
    top = sorted((r.cls % (1 << 64), r.c) for r in heavy.orderBy(F.desc("c"), "cls").limit(HEAVY).toLocalIterator())
    heavy, often = np.array([t[0] for t in top], U), np.array([t[1] for t in top], np.int64)
    # first fingerprints that several sets have: N^2 / 2^65 of N classes, a handful in 10^10
    worded = base.where("n > 0")
    twice = worded.groupBy("cls").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("cls")
    twice = np.sort(np.array([r.cls % (1 << 64) for r in twice.toLocalIterator()], U))
    if len(twice):
        worded = worded.withColumn("cls", F.when(F.col("cls").isin([int(c) for c in twice.view(np.int64)]), F.col("c")).otherwise(F.col("cls")))
    # about half as many signatures as shingles
    shingles = base.agg(F.sum("n")).first()[0] or 0
    members, pairs = _members(docs, text, bands, heavy, often, twice, bits, 1 + int(shingles // (2 * BUCKET)))

    stars = cut(pairs.groupBy("centre", "cls").agg(F.count("*").alias("k"), F.max("need").alias("need")).where("k >= need").select("centre", "cls"))
    needed = stars.select("cls").unionByName(stars.select(F.col("centre").alias("cls"))).distinct()
    roots = cut(components(cut(_verified(stars, _sets(docs, text, needed, twice, bits), threshold))))

    tiles = cut(_tiles(cut(_open_keys(members, roots, threshold))))
    links = cut(_across(tiles, _sets(docs, text, tiles.select("cls").distinct(), twice, bits), threshold))
    if links.limit(1).count():
        roots = cut(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links)))

    # from a row per class to a row per document; a class or component may hold many
    by_class = cut(worded.groupBy("cls").agg(F.min("k").alias("k"), F.count("*").alias("rows")).join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    of_root = by_class.groupBy("root").agg(F.min("k").alias("component_id"), F.count("*").alias("classes"))
    sums = by_class.agg(F.count("*"), F.sum("rows")).first()
    named = salted_join(by_class.select("cls", "rows", "root"), of_root.select("root", "component_id"), "root", hot_keys(of_root, "root", "classes", sums[0]), F.col("cls"))
    named = cut(named.select("cls", "rows", "component_id"))
    out = salted_join(worded, named.select("cls", "component_id"), "cls", hot_keys(named, "cls", "rows", sums[1] or 0), F.col("k"))
    out = out.select("k", "n", "component_id").unionByName(base.where("n = 0").select("k", "n", F.col("k").alias("component_id")))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id")


def filter_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, the one with the least key, with all its columns. Rows with a null key stay.
    Rows that repeat a key are one document, of which one row stays; they are ranked before the shuffle too."""
    from pyspark.sql import Window

    kept = similar(docs, key, text).where(F.col(key) == F.col("component_id")).select(F.col(key).alias("__kept")).distinct()
    columns = docs.columns
    nth = F.row_number().over(Window.partitionBy(key).orderBy(key))
    rows = docs.where(F.col(key).isNotNull()).withColumn("__nth", nth).where("__nth = 1").drop("__nth")
    rows = rows.join(kept, rows[key] == kept["__kept"], "left_semi")
    return rows.select(*columns).unionByName(docs.where(F.col(key).isNull()))


def op2(spark, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))
