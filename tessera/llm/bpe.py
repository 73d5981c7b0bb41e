"""BPE encoding and decoding with a public vocabulary.

A word's bytes are symbols of a doubly linked list; a priority queue holds the ranks of the pairs that
stand side by side. The best pair is merged, its neighbours are queued anew, and entries whose symbols
have changed since are skipped as stale. Decoding concatenates the vocabulary's strings, with a blank
between tokens where the file names no decoder. The vocabulary is read from its file by each worker;
the path is a parameter. Nothing is trained.

Nulls and edge cases: a null or empty text has no tokens and decodes to the empty text; rows are coded
one by one, so repeated rows, ids and extra columns change nothing (a column to keep that is named like a result is
refused); an empty table gives an empty result. Texts are never cut; what a worker remembers of words it has seen is bounded (MEMO).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words whose tokens a worker remembers, in each of two generations.
MEMO = 120_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: its own where that is printable, else one from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file (a BPE model with byte letters)."""

    def __init__(self, path: str, memo: int = MEMO):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("unk_token"):
            raise ValueError("a byte-letter BPE model without unknown token is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.added.items()}
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.special_starts = {s[:3] for s in self.added}
        steps = (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"]] if spec["normalizer"] else [])
        self.nfc = any(s["type"] == "NFC" for s in steps)
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        parts = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        split = next(p for p in parts if p["type"] == "Split")
        # the pattern only takes words, never blanks, so white space needs no rewriting before it
        self.words = regex.compile(split["pattern"]["Regex"])
        letters = byte_letters()
        self.first = [self.vocab.get(c) for c in letters]
        self.last = [self.vocab.get(c + self.suffix) for c in letters]
        self.memo, self.new, self.old = memo, {}, {}

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower() if self.lower else text
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            # letter by letter: the form of a final sigma does not depend on its place
            text = "σ".join(p.lower() for p in text.split("Σ")) if "Σ" in text else text.lower()
        return text

    def merge(self, word: str) -> list[int]:
        """Token ids of one word."""
        raw = word.encode("utf-8")
        ids = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        if None in ids:
            ids = [i for i in ids if i is not None]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        get, push, pop = merges.get, heapq.heappush, heapq.heappop
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            m = get((ids[i], ids[i + 1]))
            if m is not None:
                queue.append((m[0], i, m[1], ids[i], ids[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, made, a, b = pop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = get((made, ids[k]))
                if m is not None:
                    push(queue, (m[0], i, m[1], made, ids[k]))
            h = before[i]
            if h >= 0:
                m = get((ids[h], made))
                if m is not None:
                    push(queue, (m[0], h, m[1], ids[h], made))
        return [i for i in ids if i >= 0]

    def word(self, word: str) -> bytes:
        """A word's ids as little-endian unsigned 32-bit integers."""
        got = self.old.get(word)
        if got is None:
            got = np.array(self.merge(word), dtype="<u4").tobytes()
        if len(self.new) >= self.memo:
            self.old, self.new = self.new, {}
        self.new[word] = got
        return got

    def forget(self) -> None:
        self.new, self.old = {}, {}

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, little-endian, 4 bytes each."""
        if not text:
            return b""
        if self.specials and any(s in text for s in self.added):
            return b"".join(
                np.array([self.added[p]], dtype="<u4").tobytes() if p in self.added else self.plain(p) for p in self.specials.split(text) if p
            )
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        get, word = self.new.get, self.word
        out = []
        for w in self.words.findall(self.normal(text)):
            got = get(w)
            if got is None:
                got = word(w)
                get = self.new.get
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def coded(df: DataFrame, path: str | None = None, keep: Iterable[str] = ("doc_id",), text: str = "text", digest: bool = False) -> DataFrame:
    """The kept columns, n_tokens, and ids (array<int>) and decoded, or their SHA-256 digests. Map-only.

    path: of the tokenizer's file, the same on every executor; None: the public 49k word vocabulary.
    """
    keep = list(keep)
    from tessera.llm.shared import no_clash

    more = [("n_tokens", T.LongType()), ("ids_sha256" if digest else "ids", T.StringType() if digest else T.ArrayType(T.IntegerType())), ("decoded_sha256" if digest else "decoded", T.StringType())]
    no_clash(keep, [n for n, _ in more])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_path())
        for batch in batches:
            texts = batch.column(len(keep))
            for at in range(0, len(texts), 1000):
                part = texts.slice(at, 1000)
                counts, left, right = [], [], []
                for t in part:
                    ids = c.encode(t.as_py())
                    counts.append(len(ids) // 4)
                    said = c.decode(ids)
                    left.append(hashlib.sha256(ids).hexdigest() if digest else np.frombuffer(ids, "<i4"))
                    right.append(hashlib.sha256(said.encode("utf-8")).hexdigest() if digest else said)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(at, 1000) for i in range(len(keep))]
                    + [pa.array(counts, pa.int64()), pa.array(left, pa.string() if digest else pa.list_(pa.int32())), pa.array(right, pa.string())],
                    names=[*keep, *[n for n, _ in more]],
                )
        c.forget()  # the worker lives on for other stages

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.shared import table

    return coded(table(spark, sf_dir, "documents"), digest=True)
