"""Personal data by patterns, and information-theoretic sanitisation of what reveals it. DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. For the rest, the corpus
tells how strongly a term reveals such an entity: over all documents, PMI(entity; term) is set against the
entity's information content IC(entity) = -log2 p(entity); their ratio is the share of the entity that the
term discloses (1: whoever sees the term knows the entity). Terms are the words of a document that holds
the entity, at any distance from it, so that co-occurrence and the term's own count are of whole documents;
the evidence must come from two different contexts (WINDOW code points on both sides of the entity), so that
copies of one text prove nothing. A term that discloses REMOVE or more is removed from the documents that
hold the entity, one that discloses GENERALISE or more is replaced by its class.

Java's regular expressions run here, so patterns are written without anything that backtracks over a long
run or recurses: each is the equal of its plain form, quoted beside it.

Nulls and edge cases: a null text counts as empty and stays null when sanitised; rows are judged by
themselves, repeated rows each count as a document; documents without a base span are never changed; spans
may overlap, and sanitising treats what overlaps as one; extra columns stay; an empty table gives an empty
result. Nothing is cut: texts may be as long as memory allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut, table

KINDS = ("email", "ip", "card", "phone", "term")
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")

#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ : a run before the @ is entered at its begin or where the last match ended
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?![A-Za-z0-9-]|\.[A-Za-z0-9-])"
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: [0-9]([\x20-]?[0-9])+ : up to where neither a digit nor a separator and a digit follow
CARD = r"[0-9][0-9 -]*?(?![0-9]|[ -][0-9])"
#: \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A text without a match of these has none of the kind.
MAY = (r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:[0-9][ -]?){13}[0-9]", r"\+[0-9][ ().0-9-]")
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
HOLDS = (
    "true",
    rf"x.v rlike '^{PART}[.]{PART}[.]{PART}[.]{PART}$'",
    "length(translate(x.v, ' -', '')) between 14 and 19 and luhn_check(translate(x.v, ' -', ''))",
    "length(translate(x.v, '+ ().-', '')) between 10 and 15",
)

WINDOW = 100
PIECE = 1024
WORD = r"\p{L}{3,}"
GENERALISE, REMOVE = 0.8, 0.95
SPANS = "array<struct<s:int,k:int,e:int,v:string>>"


def _q(s: str) -> str:
    return "r'" + s + "'"


def let(name: str, value: str, body: str) -> str:
    """SQL for body, in which name stands for value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(values: str, plus: str) -> str:
    """SQL for what plus (of x and y) makes of each beginning of an array of integers, by doubling steps: n log n,
    where an array that grows by one is copied n times."""
    shifted = "concat(array_repeat(0, cast(shiftleft(1, k) as int)), slice(a, 1, size(a) - cast(shiftleft(1, k) as int)))"
    return f"aggregate(sequence(0, cast(ceil(log2(size({values}) + 1)) as int)), {values}, (a, k) -> if(size(a) > shiftleft(1, k), zip_with(a, {shifted}, (x, y) -> {plus}), a))"


def found(text: str, pattern: str, kind: int) -> str:
    """SQL for the spans of a pattern (an SQL expression) in code points: begin s, kind k, end e, value v."""
    # what split leaves and what extract finds alternate in the text; a last piece has no match after it
    ends = running("transform(zip_with(t.p, t.m, (p, m) -> length(p) + length(m)), x -> coalesce(x, 0))", "x + y")
    spans = f"filter(zip_with(t.m, {ends}, (m, e) -> if(m is null, null, named_struct('s', e - length(m), 'k', {kind}, 'e', e, 'v', m))), x -> x is not null)"
    return let("t", f"named_struct('p', split({text}, {pattern}, -1), 'm', regexp_extract_all({text}, {pattern}, 0))", spans)


def pieces(text: str) -> str:
    """SQL for a text column in pieces of PIECE code points, from which part cuts."""
    return f"regexp_extract_all(`{text}`, '(?s).{{1,{PIECE}}}', 0)"


def part(lo: str, hi: str) -> str:
    """SQL for the code points lo to hi of the text whose __pieces these are, in time of hi - lo and not of lo."""
    return f"substring(array_join(slice(__pieces, {lo} div {PIECE} + 1, {hi} div {PIECE} - {lo} div {PIECE} + 1), ''), {lo} % {PIECE} + 1, {hi} - {lo})"


def apart(base: str, other: str) -> str:
    """SQL for the spans of other that overlap none of base, by one sort of both and a running maximum."""
    # a base span counts for the others that end beyond its begin
    events = f"array_sort(concat(transform({base}, b -> named_struct('at', b.s, 'q', 1, 'e', b.e, 't', cast(null as struct<s:int,k:int,e:int,v:string>))), transform({other}, t -> named_struct('at', t.e, 'q', 0, 'e', 0, 't', t))))"
    reach = running("transform(ev, v -> v.e)", "greatest(x, y)")
    return let("ev", events, f"transform(filter(zip_with(ev, {reach}, (v, m) -> named_struct('t', v.t, 'ok', v.q = 0 and m <= v.t.s)), v -> v.ok), v -> v.t)")


def base_spans(text: str) -> Column:
    """The base spans of a text column, by begin and then kind."""
    parts = []
    for k, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        parts.append(f"if({text} rlike {_q(MAY[k])}, filter({found(text, _q(pattern), k)}, x -> {HOLDS[k]}), cast(array() as {SPANS}))")
    return F.expr(f"coalesce(array_sort(concat({', '.join(parts)})), cast(array() as {SPANS}))")


def entities(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with base spans (stored, with __row and __spans), and those without."""
    spanned = docs.withColumn("__spans", base_spans(f"coalesce(`{text}`, '')"))
    with_any = spanned.where(F.size("__spans") > 0).withColumn("__row", F.monotonically_increasing_id())
    return cut(with_any), spanned.where(F.size("__spans") == 0)


def disclosing(docs: DataFrame, held: DataFrame, text: str = "text", window: int = WINDOW, generalise: float = GENERALISE) -> DataFrame:
    """__row, t, share: the terms that disclose an entity of the row, and how much of it."""
    t = F.col(text)
    # the surroundings of each span, cut from the text's pieces; words that the window cuts are not whole
    size = "__size"
    before = f"if(x.s > {window}, regexp_replace({part(f'(x.s - {window})', 'x.s')}, r'^\\p{{L}}+', ''), {part('0', 'x.s')})"
    after = f"if({size} > x.e + {window}, regexp_replace({part('x.e', f'(x.e + {window})')}, r'\\p{{L}}+$', ''), {part('x.e', size)})"
    near = f"transform(__spans, x -> named_struct('k', x.k, 'v', x.v, 'c', lower(concat({before}, ' | ', {after}))))"
    occurrence = held.select("__row", F.explode(F.expr(let("__size", f"length(`{text}`)", let("__pieces", pieces(text), near)))).alias("x"))
    seen = occurrence.select("__row", F.xxhash64("x.k", F.lower("x.v")).alias("e"), F.col("x.c").alias("c")).withColumn("h", F.xxhash64("c"))
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(WORD), F.lit(0))))
    near = seen.select("__row", "e", words(F.col("c")).alias("t"), "h").groupBy("__row", "e", "t").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    near = cut(near)
    # an entity's contexts in a document as one: they stand for the terms of the document that are in none of them
    per = cut(seen.groupBy("__row", "e").agg(F.xxhash64(F.array_sort(F.collect_set("h"))).alias("h")))
    with_e = per.groupBy("e").agg(F.count("*").alias("n_e"))
    with_t = cut(docs.select(words(F.lower(t)).alias("t")).groupBy("t").agg(F.count("*").alias("n_t")))
    n = docs.count()

    # Entities of the same documents whose contexts are equal in the same ones of them share every fate of a term that
    # is near none of them: such a class is counted once. The least row with an equal context stands for the context.
    shared = per.join(with_e.where("n_e > 1"), "e")
    shared = cut(shared.join(shared.groupBy("e", "h").agg(F.min("__row").alias("h0")), ["e", "h"]).select("__row", "e", F.col("h0").alias("h"), "n_e"))
    prints = [F.hex(F.bit_xor(F.xxhash64(F.lit(k), "__row", "h"))) for k in (1, 2)]
    class_of = cut(shared.groupBy("e").agg(F.concat(*prints).alias("c"), F.max("n_e").alias("n_e")))
    sizes = class_of.groupBy("c").agg(F.count("*").alias("size"), F.max("n_e").alias("n_e"))
    members = shared.join(class_of.select("e", "c"), "e").groupBy("c", "__row").agg(F.min("h").alias("h"), F.max("n_e").alias("n_e"))

    # both <= n_e, so share >= generalise needs n_t <= n^(1 - generalise) * n_e^generalise; and a document by itself
    # is one context, so a term away from the entity needs two. What is left out here can't disclose anything.
    members = members.withColumn("most", F.pow(F.lit(float(n)), F.lit(1 - generalise)) * F.pow("n_e", F.lit(generalise)) * (1 + 1e-9))
    rare = with_t.where(F.col("n_t") > 1).join(F.broadcast(members.agg(F.max("most").alias("top"))), F.col("n_t") <= F.col("top")).select("t", "n_t")
    own = cut(held.select("__row", words(F.lower(t)).alias("t")).join(rare, "t"))
    # A term needs two of a class's documents, so its longest one proposes none: it is asked for what the others propose.
    # A list of thousands of entities, each with a page of its own, is thus as much work as the pages.
    members = cut(members.join(own.groupBy("__row").agg(F.count("*").alias("words")), "__row"))
    longest = members.groupBy("c").agg(F.max(F.struct("words", "__row")).alias("x")).select("c", F.col("x.__row").alias("__row"))
    others = members.join(longest, ["c", "__row"], "left_anti")
    proposed = cut(others.join(own, "__row").where(F.col("n_t") <= F.col("most")).select("c", "t", "__row", "h"))
    asked = proposed.select("c", "t").distinct().join(members.join(longest, ["c", "__row"]).select("c", "__row", "h"), "c").join(own.select("__row", "t"), ["__row", "t"])
    pairs = cut(proposed.unionByName(asked.select("c", "t", "__row", "h")))
    both = pairs.groupBy("c", "t").agg(F.count("*").alias("both"), F.min("h").alias("lo"), F.max("h").alias("hi"))

    def strong(df: DataFrame) -> DataFrame:
        pmi = F.log2(F.col("both") * F.lit(float(n)) / (F.col("n_e") * F.col("n_t").cast("double")))
        content = F.log2(F.lit(float(max(n, 1))) / F.col("n_e"))
        return df.join(with_t, "t").withColumn("share", F.when(content > 0, pmi / content).otherwise(0.0)).where(F.col("share") >= generalise)

    # terms near an entity have its own contexts for evidence; one that is elsewhere in another document has two
    close = near.groupBy("e", "t").agg(F.count("*").alias("n_near"), F.min("lo").alias("near_lo"), F.max("hi").alias("near_hi"))
    close = close.join(with_e, "e").join(class_of.select("e", "c"), "e", "left")
    close = cut(close.join(both.select("c", "t", "both"), ["c", "t"], "left").withColumn("both", F.greatest("n_near", F.coalesce("both", F.lit(0)))))
    by_entity = strong(close.where("near_lo <> near_hi or n_near < both")).select("e", "c", "t", "share")
    # and for the entities of a class that it is near to nowhere, the documents' contexts are the evidence
    nowhere = both.where("lo <> hi").join(sizes, "c").join(close.where("c is not null").groupBy("c", "t").agg(F.count("*").alias("k")), ["c", "t"], "left").where("coalesce(k, 0) < size")
    by_class = strong(nowhere).select("c", "t", "share").unionByName(by_entity.where("c is not null").select("c", "t", "share"))
    found = pairs.join(by_class.groupBy("c", "t").agg(F.max("share").alias("share")), ["c", "t"]).select("__row", "t", "share")
    return found.unionByName(near.join(by_entity.select("e", "t", "share"), ["e", "t"]).select("__row", "t", "share")).groupBy("__row", "t").agg(F.max("share").alias("share"))


def with_terms(docs: DataFrame, held: DataFrame, text: str = "text", remove: float = REMOVE) -> DataFrame:
    """held with __all: base spans and the spans of disclosing terms (value v: remove or generalise)."""
    act = F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("act")
    terms = cut(disclosing(docs, held, text).select("__row", "t", act))
    # the words of the documents that have such terms, joined to them: a document may have thousands
    some = held.join(terms.select("__row").distinct(), "__row", "left_semi")
    said = some.select("__row", F.explode(F.expr(found(f"`{text}`", _q(WORD), 4))).alias("x")).select("__row", "x.s", "x.e", F.lower("x.v").alias("t"))
    span = F.struct("s", F.lit(4).alias("k"), "e", F.col("act").alias("v"))
    spans = said.join(terms, ["__row", "t"]).groupBy("__row").agg(F.array_sort(F.collect_list(span)).alias("__found"))
    joined = held.join(spans, "__row", "left").withColumn("__found", F.coalesce("__found", F.expr(f"cast(array() as {SPANS})")))
    return joined.withColumn("__all", F.expr(f"array_sort(concat(__spans, {apart('__spans', '__found')}))")).drop("__found")


def listed(spans: str) -> str:
    """SQL for kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"concat_ws(',', transform({spans}, x -> concat(element_at({names}, x.k + 1), ':', x.s, ':', x.e)))"


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base spans replaced by labels and disclosing terms removed or generalised; an n_chars column follows its text."""
    held, clean = entities(docs, text)
    label = "case when x.k < 4 then element_at(array(" + ", ".join(f"'{x}'" for x in LABELS) + "), x.k + 1) when x.v = 'remove' then '' else '[TERM]' end"
    reach = running("transform(__all, x -> x.e)", "greatest(x, y)")
    kept = f"array_join(zip_with(__all, concat(array(0), {reach}), (x, at) -> case when x is null then {part('at', 'length(`' + text + '`)')} when x.s >= at then concat({part('at', 'x.s')}, {label}) else '' end), '')"
    new = F.expr(let("__pieces", pieces(text), kept))
    changed = with_terms(docs, held, text).withColumn(text, new)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns).unionByName(changed.select(*docs.columns))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    held, clean = entities(docs, text)
    counts = [F.expr(f"cast(size(filter(__spans, x -> x.k = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(4)]
    some = with_terms(docs, held, text).select(key, *counts, F.sha2(F.expr(listed("__spans")), 256).alias("base_sha256"), F.expr(listed("__all")).alias("spans"))
    none = clean.select(key, *[F.lit(0).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"))
    return none.unionByName(some)


def op4(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
