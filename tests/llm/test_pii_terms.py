"""The disclosing terms against a plain count over all entities and terms, and texts with very many of both."""

import math
import random
import re
import time

import pytest

from tessera.llm import pii

DOCS = "doc_id long, text string"
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
WORD = re.compile(r"[^\W\d_]{3,}")


def contexts(text):
    """(entity, its surroundings) of each address: words that the window cuts are not whole."""
    for m in MAIL.finditer(text):
        s, e = m.span()
        before = re.sub(r"^[^\W\d_]+", "", text[s - 100 : s]) if s > 100 else text[:s]
        after = re.sub(r"[^\W\d_]+$", "", text[e : e + 100]) if len(text) > e + 100 else text[e:]
        yield m[0].lower(), (before + " | " + after).lower()


def brute(docs, generalise=pii.GENERALISE):
    """doc -> term -> share."""
    n = len(docs)
    words = {i: set(WORD.findall(t.lower())) for i, t in docs}
    seen = {i: {} for i, _ in docs}
    for i, t in docs:
        for e, c in contexts(t):
            seen[i].setdefault(e, set()).add(c)
    holders, n_t = {}, {}
    for i, by in seen.items():
        for e in by:
            holders.setdefault(e, []).append(i)
    for ws in words.values():
        for w in ws:
            n_t[w] = n_t.get(w, 0) + 1
    out = {}
    for e, rows in holders.items():
        for t in set().union(*[words[i] for i in rows]):
            proof, at = set(), []
            for i in rows:
                near = {c for c in seen[i][e] if t in WORD.findall(c)}
                if near:
                    proof |= near
                    at.append(i)
                elif t in words[i] and len(rows) > 1:
                    proof.add(frozenset(seen[i][e]))
                    at.append(i)
            if len(proof) < 2 or len(rows) == n:
                continue
            share = math.log2(len(at) * n / (len(rows) * n_t[t])) / math.log2(n / len(rows))
            if share >= generalise:
                for i in at:
                    out.setdefault(i, {})
                    out[i][t] = max(share, out[i].get(t, 0.0))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(150)]
    mails = [f"u{i}@x{i % 5}.de" for i in range(25)]
    rows, n = [], 0
    for g in range(14):  # groups that share entities and words, near and far, copies among them
        own, some = ["".join(rng.choice("klmnopqrst") for _ in range(6)) for _ in range(6)], rng.sample(mails, rng.choice((1, 2, 4)))
        base = None
        for _ in range(rng.choice((1, 2, 3, 5))):
            w = [rng.choice(own if rng.random() < 0.4 else vocabulary) for _ in range(rng.choice((5, 40, 120)))]
            for m in some:
                for _ in range(rng.choice((1, 1, 2))):
                    w.insert(rng.randrange(len(w) + 1), m)
            text = " ".join(w)
            if base and rng.random() < 0.3:
                text = base if rng.random() < 0.5 else base + " " + rng.choice(own)
            base = base or text
            rows.append((n := n + 1, text))
    rows += [(n + 1 + i, " ".join(rng.choice(vocabulary) for _ in range(20))) for i in range(80)]
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_terms_equal_a_plain_count(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, DOCS)
    held, _ = pii.entities(docs)
    found = pii.disclosing(docs, held).join(held.select("__row", "doc_id"), "__row").collect()
    want = brute(rows)
    assert {(r.doc_id, r.t): round(r.share, 9) for r in found} == {(i, t): round(s, 9) for i, by in want.items() for t, s in by.items()}
    assert len(found) > 20


def timed(spark, rows):
    began = time.time()
    out = pii.digests(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    return time.time() - began, {r.doc_id: r for r in out}


def test_near_copies_with_thousands_of_addresses(spark):
    """Two texts that share 16,000 addresses and as many words: one class of entities, not their product with the words."""
    n = 16_000
    text = " ".join(f"u{i}@x.de {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}word" for i in range(n))
    rows = [(1, text), (2, "start " + text)] + [(10 + i, f"short text {i} of few words") for i in range(100)]
    took, got = timed(spark, rows)
    assert got[1].n_email == got[2].n_email == n and took < 60


def test_a_list_of_addresses_with_a_page_each(spark):
    """Every address of a list has a page of its own: the work is the pages', not the list's words times its addresses."""
    n = 4_000
    three = lambda i: f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}"
    listing = " ".join(f"u{i}@x.de {three(i)}name" for i in range(n))
    rows = [(0, listing)] + [(1 + i, f"page {three(i)}name and {three(i)}only here, write to u{i}@x.de today") for i in range(n)]
    took, got = timed(spark, rows)
    assert took < 60 and "term" in got[1].spans  # the name stands beside the address in two contexts
