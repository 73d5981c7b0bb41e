"""Detection: text -> spans, in one Arrow pass; calibration, overlap resolution and what follows per document."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import taxonomy as X
from tessera.functions import patterns as P

SPAN = "struct<start:int,end:int,text:string,entity_type:string,confidence:double,raw_confidence:double,detector:string,tier:int>"


class Span(NamedTuple):
    start: int
    end: int
    text: str
    entity_type: str
    confidence: float
    raw_confidence: float
    detector: str
    tier: int


def secret_context(text: str, start: int, end: int) -> bool:
    around = text[max(0, start - 50) : start].lower() + " " + text[end : end + 50].lower()
    return any(c in around for c in P.SECRET_CONTEXT)


_ANNOUNCES = "|".join(map(re.escape, P.NO_SSN_BEFORE))
#: A word that announces another kind of number; at a separator that touches the number, also as the end of a word.
_NO_SSN = re.compile(rf"\b(?:{_ANNOUNCES})\b|(?:{_ANNOUNCES})\s*[#:.-]\Z")


def ssn_context(text: str, start: int) -> bool:
    """Whether nothing before nine bare digits says that they are another kind of number."""
    return not _NO_SSN.search(text[max(0, start - P.NO_SSN_WINDOW) : start].lower())


def family_spans(family: P.Family, text: str, seen: P.Seen | None = None) -> list[Span]:
    """Raw spans of one family: per place the first pattern wins, per place and type the surest."""
    best: dict[tuple, Span] = {}
    seen = seen or P.Seen(text)
    for pattern in family.patterns:
        if not seen.may_match(pattern.regex):
            continue
        for m in pattern.regex.finditer(text):
            value, (a, b) = m[1], m.span(1)
            if not value.strip():
                continue
            sure = pattern.confidence
            if pattern.check is not None:
                got = pattern.check(value)
                if not got:
                    continue
                # a checksum's own confidence counts; elsewhere passing the check adds a little
                sure = got if family.name == "checksum" else min(0.99, pattern.confidence + 0.02)
            if pattern.kind == "SSN" and sure <= P.NO_SSN_SURE and not ssn_context(text, a):
                continue
            key = (a, b, pattern.kind) if family.name == "pattern" else (a, b)
            old = best.get(key)
            if old is not None and (family.name != "pattern" or old.confidence >= sure):
                continue
            if family.name == "government":
                best.setdefault(key, None)  # the place is taken even where the context speaks against it
                if pattern.kind == "CLASSIFICATION_LEVEL" and "secret" in value.lower() and "top" not in value.lower() and not secret_context(text, a, b):
                    continue
            best[key] = Span(a, b, value, pattern.kind, sure, sure, family.name, family.tier)
    return [s for s in best.values() if s is not None]


def calibrated(s: Span) -> Span:
    lo, hi = X.TIER_BANDS[s.tier]
    return s._replace(confidence=lo + s.raw_confidence * (hi - lo))


def _prefers(a: Span, b: Span, strategy: str) -> bool:
    """Whether a beats b, of another type, where they overlap in part."""
    key = {"higher_confidence": lambda s: (s.confidence, s.tier), "higher_tier": lambda s: (s.tier, s.confidence), "longer_span": lambda s: (s.end - s.start, s.confidence)}[strategy]
    return key(a) > key(b)


def resolve(spans: Iterable[Span], threshold: float = X.THRESHOLD, strategy: str = "higher_confidence") -> list[Span]:
    """Spans without overlaps. Order and ties are fixed by (end, detector, type), so the input's order doesn't matter."""
    kept: list[Span] = []
    for new in sorted((s for s in spans if s.confidence >= threshold), key=lambda s: (s.start, -s.tier, -s.confidence, s.end, s.detector, s.entity_type)):
        # kept spans are disjoint and ordered: only the last ones can overlap
        while new is not None and kept and kept[-1].end > new.start:
            old = kept[-1]
            same_place = (old.start, old.end) == (new.start, new.end)
            if same_place:
                if (new.tier, new.confidence) > (old.tier, old.confidence):
                    kept[-1] = new
                new = None
            elif old.start <= new.start and new.end <= old.end:
                new = None
            elif new.start <= old.start and old.end <= new.end:
                kept.pop()
            elif X.normalize(old.entity_type) == X.normalize(new.entity_type):
                kept.pop()
                base = new if (new.tier, new.confidence) > (old.tier, old.confidence) else old
                new = base._replace(start=old.start, end=new.end, text=old.text + new.text[old.end - new.start :], confidence=max(old.confidence, new.confidence))
            elif _prefers(new, old, strategy):
                kept.pop()
            else:
                new = None
        if new is not None:
            kept.append(new)
    return sorted(kept, key=lambda s: (s.start, -s.end))


def dedupe_tiered(spans: Iterable[Span]) -> list[Span]:
    """The tiered pipeline's rule: only identical or contained spans go, partial overlaps stay. Linear after the sort:
    starts only grow, so a span lies in an earlier one if it ends no later than the farthest end so far."""
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, -(s.end - s.start), -s.tier, -s.confidence, s.detector, s.entity_type)):
        if not kept or s.end > kept[-1].end:
            kept.append(s)
    return kept


def detect_text(text: str | None, families: Sequence[str] = P.PRESETS["full"], threshold: float = X.THRESHOLD, strategy: str = "higher_confidence", resolved: bool = True) -> list[Span]:
    """All families over a text; a family that fails is left out, the others count."""
    if not text:
        return []
    found: list[Span] = []
    seen = P.Seen(text)
    for name in families:
        try:
            found += family_spans(P.FAMILIES[name], text, seen)
        except (RecursionError, OverflowError):
            continue
    found = [calibrated(s) for s in found]
    return resolve(found, threshold, strategy) if resolved else found


def detect_udf(families: Sequence[str] = P.PRESETS["full"], threshold: float = X.THRESHOLD, strategy: str = "higher_confidence", resolved: bool = True):
    """text -> array<span>, offsets in code points."""

    @F.pandas_udf(f"array<{SPAN}>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [s._asdict() for s in detect_text(t, families, threshold, strategy, resolved)])

    return run


def as_spans(rows) -> list[Span]:
    """Spans of an array<span> value as pandas gets it."""
    return [] if rows is None else [Span(**r) for r in rows]


def tiered(spans: Column) -> Column:
    """Raw spans of a document without identical and contained ones."""

    @F.pandas_udf(f"array<{SPAN}>")
    def run(found: pd.Series) -> pd.Series:
        return found.map(lambda rows: [s._asdict() for s in dedupe_tiered(as_spans(rows))])

    return run(spans)


def disjoint(spans: Column) -> Column:
    """Raw spans of a document without overlaps."""

    @F.pandas_udf(f"array<{SPAN}>")
    def run(found: pd.Series) -> pd.Series:
        return found.map(lambda rows: [s._asdict() for s in resolve(as_spans(rows))])

    return run(spans)


def with_pronouns(text: Column, spans: Column) -> Column:
    """A document's spans and those of the pronouns that its names explain."""

    @F.pandas_udf(f"array<{SPAN}>")
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([[s._asdict() for s in coreference(t or "", as_spans(rows))] for t, rows in zip(texts, found)], dtype=object)

    return run(text, spans)


def canonical_entities(spans: Column) -> Column:
    """Canonical entities of a document."""

    @F.pandas_udf("array<struct<canonical:string,entity_type:string,mentions:int>>")
    def run(found: pd.Series) -> pd.Series:
        return found.map(lambda rows: resolve_entities(as_spans(rows)))

    return run(spans)


def with_spans(df: DataFrame, text: str = "text", **options) -> DataFrame:
    return df.withColumn("spans", detect_udf(**options)(F.col(text)))


def entity_counts(spans: Column) -> Column:
    """Normalized type -> count, without a shuffle: a document's spans are at hand."""
    kinds = F.transform(spans, lambda s: X.normalized(s["entity_type"]))
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda t: F.struct(t.alias("key"), F.size(F.filter(kinds, lambda k: k == t)).alias("value"))))


# --- chunks ------------------------------------------------------------------------------------------
def chunks(text: str, size: int = 4000, overlap: int = 200) -> list[tuple[int, int, str]]:
    """Pieces of at most `size` that overlap; a piece ends at its last blank if that lies in its second half."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            blank = text.rfind(" ", start + size // 2, end)
            end = blank if blank > 0 else end
        out.append((start, end, text[start:end]))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def chunk_udf(size: int = 4000, overlap: int = 200):
    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "text": c} for a, b, c in chunks(t or "", size, overlap)])

    return run


# --- overlap pairs and positions ----------------------------------------------------------------------
def overlapping_pairs(spans: DataFrame, key: str = "doc_id", skip_identical: bool = True) -> DataFrame:
    """Pairs of spans of a document that overlap: rows need id, start, end."""
    a = spans.select(F.col(key), F.col("id").alias("a"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = spans.select(F.col(key).alias("__k"), F.col("id").alias("b"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    on = (a[key] == b["__k"]) & ((a["a_start"] < b["b_start"]) | ((a["a_start"] == b["b_start"]) & (a["a"] < b["b"]))) & (b["b_start"] < a["a_end"])
    pairs = a.join(b, on).drop("__k")
    return pairs.where("not (a_start = b_start and a_end = b_end)") if skip_identical else pairs


def valid_position(span: Column, text: Column) -> Column:
    return (span["start"] >= 0) & (span["start"] < span["end"]) & (span["end"] <= F.length(text)) & (F.length(span["text"]) == span["end"] - span["start"])


# --- coreference, names, entities --------------------------------------------------------------------
#: Pronouns, given names, abbreviations.
PRONOUNS = {**dict.fromkeys("he him his".split(), "M"), **dict.fromkeys("she her hers".split(), "F"), **dict.fromkeys("they them their theirs".split(), None)}
# The most frequent given names of the US census of 1990, by rank.
FEMALE = frozenset((
    "mary", "patricia", "linda", "barbara", "elizabeth", "jennifer", "maria", "susan", "margaret", "dorothy", "lisa", "nancy", "karen", "betty", "helen", "sandra",
    "donna", "carol", "ruth", "sharon", "michelle", "laura", "sarah", "kimberly", "deborah", "jessica", "shirley", "cynthia", "angela", "melissa", "jane", "anna",
))
MALE = frozenset((
    "james", "john", "robert", "michael", "william", "david", "richard", "charles", "joseph", "thomas", "christopher", "daniel", "paul", "mark", "donald", "george",
    "kenneth", "steven", "edward", "brian", "ronald", "anthony", "kevin", "jason", "matthew", "gary", "timothy", "jose", "larry", "jeffrey", "frank", "andrew",
))
ABBREVIATIONS = frozenset(("dr", "mr", "mrs", "ms", "prof", "rev", "jr", "sr", "st", "no", "vs", "etc", "inc", "ltd", "corp", "co", "e.g", "i.e"))
_PRONOUN = re.compile(r"\b(" + "|".join(PRONOUNS) + r")\b", re.I)


def sentences(text: str) -> list[int]:
    """Where each sentence begins: after a word that ends in . ! or ? (closing quotes and brackets may follow) and is
    neither an abbreviation nor an initial."""
    begins, ended = [0], False
    for word in re.finditer(r"\S+", text):
        if ended:
            begins.append(word.start())
        bare = word[0].rstrip("\"')]")
        stem = bare.rstrip(".!?").lstrip("\"'([").lower()
        ended = bare != bare.rstrip(".!?") and (bare[-1] != "." or not (stem in ABBREVIATIONS or len(stem) == 1 and stem.isalpha()))
    return begins


def gender(name: str) -> str | None:
    first = name.split()[0].lower().rstrip(".") if name.split() else ""
    return "F" if first in FEMALE else "M" if first in MALE else None


def coreference(text: str, spans: list[Span], window: int = 2, most: int = 3, least: float = 0.85, decay: float = 0.9) -> list[Span]:
    """spans and a span for each pronoun that a name before it, at most `window` sentences away, explains."""
    import bisect

    anchors = [s for s in spans if s.entity_type.startswith("NAME") and s.confidence >= least]
    if not anchors:
        return list(spans)
    begins = sentences(text)
    at = lambda pos: bisect.bisect_right(begins, pos) - 1
    taken, used, out = {(s.start, s.end) for s in spans}, {}, []
    for m in _PRONOUN.finditer(text):
        if m.span() in taken:
            continue
        wants = PRONOUNS[m[0].lower()]
        fits = [a for a in anchors if a.end <= m.start() and 0 <= at(m.start()) - at(a.start) <= window and (wants is None or gender(a.text) in (None, wants))]
        if not fits:
            continue
        a = max(fits, key=lambda s: s.end)
        if used.get(a, 0) >= most:
            continue
        used[a] = used.get(a, 0) + 1
        sure = a.confidence * decay * (0.8 if len({f.text for f in fits}) > 1 else 1.0)
        out.append(Span(*m.span(), m[0], a.entity_type, sure, sure, "coref", P.ML))
    return sorted([*spans, *out], key=lambda s: (s.start, -s.end))


def groups(n: int, pairs: Iterable[tuple[int, int]]) -> list[int]:
    """Component of each of n items: the least item that pairs reach."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def resolve_entities(spans: list[Span]) -> list[dict]:
    """Canonical entities: mentions with equal texts, and names that share a word, are one; the longest, then earliest text names it."""
    by_text, by_word, pairs = {}, {}, []
    for i, s in enumerate(spans):
        kind = "NAME" if s.entity_type.startswith("NAME") else X.normalize(s.entity_type)
        keys = [(by_text, (kind, s.text.lower().strip()))]
        if kind == "NAME" and s.detector != "coref":
            keys += [(by_word, w) for w in re.findall(r"[^\W\d_]{2,}", s.text.lower())]
        for table, k in keys:
            pairs.append((table.setdefault(k, i), i))
    out: dict[int, list[Span]] = {}
    for s, g in zip(spans, groups(len(spans), pairs)):
        out.setdefault(g, []).append(s)
    return [{"canonical": min(m, key=lambda s: (-len(s.text), s.start)).text, "entity_type": X.normalize(m[0].entity_type), "mentions": len(m)} for m in out.values()]


# --- context and escalation --------------------------------------------------------------------------
#: Words that make a text medical.
MEDICAL = "diagnosis diagnosed patient treatment prescription prescribed physician nurse hospital clinic surgery symptom therapy medication dosage mg icd-10".split()
ICD10 = r"\b[A-TV-Z][0-9][0-9AB](?:\.[0-9A-TV-Z]{1,4})?\b"
DRUG_SUFFIX = r"\b\w{3,}(?:cillin|mycin|statin|prazole|olol|sartan|pril|azepam|cycline|floxacin)\b"
ML_BENEFICIAL = ("NAME", "ADDRESS", "DATE", "FACILITY")


def medical(text: Column) -> Column:
    """Whether a text is medical: a term, a drug's ending or a diagnosis code. Runs in the JVM."""
    low = F.lower(text)
    return low.rlike(r"\b(?:" + "|".join(MEDICAL) + r")\b") | low.rlike(DRUG_SUFFIX) | text.rlike(ICD10)


def escalate(spans: Column, text: Column) -> Column:
    """Whether a slower model should see the text: an unsure span, a type it helps with, or medical context."""
    helps = lambda s: X.normalized(s["entity_type"]).isin(*ML_BENEFICIAL) & (s["raw_confidence"] < 0.90)
    return F.exists(spans, lambda s: s["raw_confidence"] < 0.70) | F.exists(spans, helps) | medical(text)


def enhance(spans: Column, text: Column, keep: float = 0.85, drop: float = 0.35, kinds: Sequence[str] = ("MRN",)) -> Column:
    """Spans of the enhanced kinds: words before them raise or lower their confidence; they are kept, sent to review, or dropped."""

    def judged(s: Column) -> Column:
        before = F.lower(F.substring(text, F.greatest(s["start"] - 40, F.lit(0)) + 1, F.least(s["start"], F.lit(40))))
        shift = F.when(before.rlike(r"\b(?:page|order|invoice|ref|phone|fax)\b"), -0.50).when(before.rlike(r"\b(?:mrn|medical record|patient|chart)\b"), 0.10).otherwise(0.0)
        sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), s["raw_confidence"] + shift))
        return F.when(s["entity_type"].isin(*kinds), sure).otherwise(F.lit(1.0))

    route = lambda c: F.when(c >= keep, "keep").when(c < drop, "reject").otherwise("verify")
    return F.filter(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), route(judged(s)).alias("route"))), lambda s: s["route"] != "reject")
