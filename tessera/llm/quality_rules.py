"""Quality rules as a bitmask ledger: every rule is evaluated once, its failure is a bit beside the
measurements, and policies, verdicts and ablations are bitwise operations on the ledger.

Nulls and edge cases: a null text has no words and fails MIN_WORDS; rows are judged one by one, so
repeated rows and ids, ties and extra columns change nothing; an empty table gives an empty ledger.
A row may be as long as memory allows; no text is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernel as K
from tessera.llm.shared import text_chunks

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_PIPE = np.zeros(256, bool)
_PIPE[ord("|")] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
_ALL = T.StructType([T.StructField(m, T.LongType(), False) for m in MEASURES])


@dataclass(frozen=True)
class Rule:
    """fails: a boolean Column over the measurements, without division, so that it is exact."""

    bit: int
    name: str
    fails: str


#: The ledger's rules. A bit keeps its meaning for good; new rules take new bits.
RULES = (
    Rule(0, "min_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "short_words", "word_chars < 2 * n_words"),
    Rule(3, "long_words", "word_chars > 15 * n_words"),
    Rule(4, "symbols", "100 * n_symbols > 15 * n_words"),
    Rule(5, "duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines"),
    Rule(6, "upper_case", "100 * n_upper > 40 * n_letters"),
    Rule(7, "no_letters", "2 * n_letters < word_chars"),
    Rule(8, "few_words", "n_words < 5"),
)
BITS = {r.name: 1 << r.bit for r in RULES}
#: Versioned policies: a row whose failure bits meet the mask is rejected.
POLICIES = {
    "base": BITS["min_words"] | BITS["repeated_windows"],
    "v1": sum(BITS[n] for n in ("min_words", "repeated_windows", "short_words", "long_words", "symbols", "duplicate_lines", "upper_case", "no_letters")),
    "lenient": sum(BITS[n] for n in ("few_words", "repeated_windows", "no_letters")),
}


def measure_chunk(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each row of a chunk."""
    n = len(offsets) - 1
    starts, ends, rows = K.word_spans(buf, offsets, K.NOT_SPACE)
    sums = K.rolling(buf)
    inside = K.NOT_SPACE[buf]
    out = {
        "n_words": np.bincount(rows, minlength=n),
        "word_chars": K.sums_by_row(inside & K.LEADS[buf], offsets),
        "n_symbols": K.sums_by_row(_SYMBOL[buf], offsets),
        "n_upper": K.sums_by_row(_UPPER[buf], offsets),
        "n_letters": K.sums_by_row(_LETTER[buf] & K.LEADS[buf], offsets),
    }
    grams, first = K.runs(K.span_hash(sums, starts, ends), rows, 3)
    hit = np.zeros(len(starts), bool)
    for j in range(3):
        hit[first[K.repeated(K.in_row(grams, rows[first]))] + j] = True
    out["n_repeat_words"] = np.bincount(rows[hit], minlength=n)
    # a line ends before \n or with its row
    breaks = np.unique(np.concatenate([np.flatnonzero(buf == 10) + 1, offsets]))
    at, stop = breaks[:-1], breaks[1:].copy()
    if len(at):
        stop[buf[stop - 1] == 10] -= 1
        words = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(inside, out=words[1:])
        worded = words[stop] > words[at]
        at, stop = at[worded], stop[worded]
    row = np.searchsorted(offsets, at, "right") - 1
    copies = K.later_copies(K.in_row(K.span_hash(sums, at, stop), row))
    out["n_lines"] = np.bincount(row, minlength=n)
    out["n_dup_lines"] = np.bincount(row[copies], minlength=n)
    return out


def measurements(df: DataFrame, keep: Iterable[str] = ("doc_id",), text: str = "text", name: str = "m") -> DataFrame:
    """The kept columns and one column with MEASURES of each row's whole text. Map-only."""
    keep = list(keep)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, _ALL, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            for a, b, buf, offsets in text_chunks(column):
                got = measure_chunk(buf, offsets)
                m = pa.StructArray.from_arrays([pa.array(got[x].astype(np.int64)) for x in MEASURES], names=list(MEASURES))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(keep))] + [m], names=[*keep, name])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def failures(struct: str = "") -> Column:
    """The failure bits of all rules, from measurement columns or from those of a struct."""
    bits = F.lit(0).cast("long")
    for r in RULES:
        fails = re.sub(r"\b(n_\w+|word_chars)\b", rf"{struct}.\1", r.fails) if struct else r.fails
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(df: DataFrame, keep: Iterable[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, the measurements and `failed_bits`."""
    keep = list(keep)
    return measurements(df, keep, text, "__m").select(*keep, "__m.*").withColumn("failed_bits", failures())


def rejects(policy: str, bits: str | Column = "failed_bits") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(POLICIES[policy]).cast("long")) != 0


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """By rule of the policy: rows that fail it, rows that only it rejects, and rows kept without it.

    One pass: rows are first counted by their failure bits (at most 2^rules groups).
    """
    mask = POLICIES[policy]
    by_bits = led.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("b")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if mask >> r.bit & 1]
    one = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules]))
    rows = by_bits.select("b", "n", one.alias("r")).select("b", "n", "r.rule", "r.bit")
    hit = F.col("b").bitwiseAND(F.col("bit")) != 0
    return rows.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("b") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("b").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def filter_documents(df: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """Rows the policy keeps, with all their columns. The verdict is made in the pass that reads the row."""
    columns = df.columns
    return measurements(df, columns, text, "__m").where(~rejects(policy, failures("__m"))).select(*columns)


def op9(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.shared import table

    led = ledger(table(spark, sf_dir, "documents"))
    base = rejects("base")
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed_bits",
        base.alias("base_failed"), (~base & ~rejects("v1")).alias("kept"),
    )
