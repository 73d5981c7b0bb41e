"""Vectorised text measures over UTF-8 bytes: words, their hashes, runs of words and counts by row."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: The largest primes below 2^31, and a base for each.
_PRIMES = (2147483647, 2147483629)
_BASES = (1318699873, 902364119)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_tables: dict[str, np.ndarray] = {}

#: Words of [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after A-Z were lower-cased): 0-9, a-z, and all beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes with A-Z lower-cased
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that begin a code point
LEADS = np.ones(256, bool)
LEADS[128:192] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the bases and of their inverses by modulus: two arrays of one row for each of _PRIMES."""
    if "up" not in _tables or _tables["up"].shape[1] < n:
        size = max(n, (1 << 18) + 1)
        for name, bases in (("up", _BASES), ("down", [pow(b, -1, p) for b, p in zip(_BASES, _PRIMES)])):
            out = np.ones((2, size), U)
            for row, base, p in zip(out, bases, _PRIMES):
                k = 1
                while k < size:
                    row[k : 2 * k] = row[: min(k, size - k)] * U(pow(base, k, p)) % U(p)
                    k *= 2
            _tables[name] = out
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(_MIX[0])
        x = x ^ (x >> U(27))
        x = x * U(_MIX[1])
        return x ^ (x >> U(31))


def spread(n: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=U)) | U(1)


def rolling(buf: np.ndarray) -> np.ndarray:
    """Prefix sums, by modulus, from which span_hash takes the hash of any span."""
    up, _ = _powers(len(buf) + 1)
    out = np.zeros((2, len(buf) + 1), U)
    values = buf.astype(U) + U(1)
    for row, powers, p in zip(out, up, _PRIMES):
        terms = values * powers[: len(buf)]  # below 2^40
        if len(buf) > 1 << 23:  # the sums would pass 2^64
            terms %= U(p)
        np.cumsum(terms, out=row[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, wherever it stands.

    Two polynomials, each modulo a prime: modulo a power of two, structured texts would collide under any base.
    """
    _, down = _powers(sums.shape[1])
    h = [(row[ends] - row[starts]) % U(p) * powers[starts] % U(p) for row, powers, p in zip(sums, down, _PRIMES)]
    with np.errstate(over="ignore"):
        return mix((h[0] | h[1] << U(31)) + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def word_spans(buf: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words; a word never crosses from a row to the next."""
    mask = in_word[buf]
    inner = offsets[1:-1]
    inner = inner[inner < len(buf)]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    begins[inner] = mask[inner]
    stops = mask.copy()
    stops[:-1] &= ~mask[1:]
    before = inner[inner > 0] - 1
    stops[before] = mask[before]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(offsets, starts, "right") - 1


def runs(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n words in a row, and the index of the first of them; runs stay within a row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    k = spread(n)
    with np.errstate(over="ignore"):
        g = hashes[:m] * k[0]
        for j in range(1, n):
            g = g + hashes[j : j + m] * k[j]
    whole = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix(g[whole]), whole


def sums_by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags over each row's bytes."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def in_row(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys that differ between rows."""
    with np.errstate(over="ignore"):
        return mix(keys ^ (rows.astype(U) + U(1)) * U(_MIX[1]))


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later_copies(keys: np.ndarray) -> np.ndarray:
    """True where a key occurred earlier."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:][s[1:] == s[:-1]]] = True
    return out
