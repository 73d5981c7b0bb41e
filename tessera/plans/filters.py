"""The filter language, compiled to a Column: Catalyst then pushes it down like any predicate.

    filter := and-terms joined by OR; terms joined by AND; NOT binds closest; parentheses
    term   := field op value | has(type) | missing(field) | count(type) op value
    op     := = != > < >= <= ~ contains
"""

from __future__ import annotations

import re
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PATTERN = 500
#: Short names of fields.
FIELDS = {"score": "risk_score", "tier": "risk_tier", "exposure": "exposure_level", "path": "file_path", "name": "file_name", "filename": "file_name", "entities": "total_entities", "total": "total_entities"}


class FilterError(ValueError):
    pass


class Compare(NamedTuple):
    field: str
    op: str
    value: Any


class Call(NamedTuple):
    name: str
    arg: str
    op: str | None = None
    value: Any = None


class Not(NamedTuple):
    of: Any


class Both(NamedTuple):
    op: str
    left: Any
    right: Any


_SCAN = re.compile(
    r"""\s*(?:(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<number>-?\d+(?:\.\d+)?(?![\w.]))|(?P<op>>=|<=|!=|=|>|<|~)|(?P<paren>[()])|(?P<word>[A-Za-z_][\w.\-]*))""", re.S)
_ESCAPES = (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\'", "'"), ("\\\\", "\\"))
_LOGIC = {"AND": "AND", "and": "AND", "OR": "OR", "or": "OR", "NOT": "NOT", "not": "NOT"}


def tokens(text: str) -> list[tuple[str, Any, int]]:
    """(kind, value, position) of each token, and an end."""
    out, at = [], 0
    while text[at:].strip():
        m = _SCAN.match(text, at)
        if not m:
            rest = len(text) - len(text[at:].lstrip())
            raise FilterError(f"unexpected character at position {rest}")
        kind, raw, start = m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)
        at = m.end()
        if kind == "string":
            raw = raw[1:-1]
            for a, b in _ESCAPES:
                raw = raw.replace(a, b)
        elif kind == "number":
            raw = float(raw) if "." in raw else int(raw)
        elif kind == "word" and raw in _LOGIC:
            kind, raw = "logic", _LOGIC[raw]
        elif kind == "word" and raw == "contains":
            kind = "op"
        elif kind == "word" and raw in ("has", "missing", "count"):
            kind = "call"
        out.append((kind, raw, start))
    return [*out, ("end", None, len(text))]


def parse(text: str):
    """The filter's tree."""
    todo = tokens(text)
    if todo[0][0] == "end":
        raise FilterError("empty filter")
    at = 0

    def take(kind: str | None = None, value: Any = None):
        nonlocal at
        k, v, p = todo[at]
        if kind and k != kind or value is not None and v != value:
            raise FilterError(f"expected {value or kind} at position {p}")
        at += 1
        return v

    def value():
        if todo[at][0] not in ("string", "number", "word"):
            raise FilterError(f"expected a value at position {todo[at][2]}")
        return take()

    def chain(op: str, below):
        left = below()
        while todo[at][:2] == ("logic", op):
            take()
            left = Both(op, left, below())
        return left

    def term():
        kind, v, p = todo[at]
        if (kind, v) == ("logic", "NOT"):
            take()
            return Not(term())
        if (kind, v) == ("paren", "("):
            take()
            inner = either()
            take("paren", ")")
            return inner
        if kind == "call":
            take()
            take("paren", "(")
            if todo[at][0] not in ("word", "string"):
                raise FilterError(f"expected a name at position {todo[at][2]}")
            arg = take()
            take("paren", ")")
            return Call(v, arg, take("op"), value()) if v == "count" else Call(v, arg)
        if kind == "word":
            return Compare(take(), take("op"), value())
        raise FilterError(f"unexpected {v!r} at position {p}")

    def both():
        return chain("AND", term)

    def either():
        return chain("OR", both)

    tree = either()
    if todo[at][0] != "end":
        raise FilterError(f"unexpected {todo[at][1]!r} at position {todo[at][2]}")
    return tree


def validate(text: str) -> str | None:
    """None, or what is wrong with a filter."""
    try:
        parse(text)
    except FilterError as e:
        return str(e)
    return None


def _field(df: DataFrame, name: str) -> tuple[Column, T.DataType] | None:
    for n in (FIELDS.get(name.lower(), name), name):
        if n in df.columns:
            return F.col(f"`{n}`"), df.schema[n].dataType
    if "." in name and name.split(".", 1)[0] in df.columns:
        try:
            c = F.col(name)
            return c, df.select(c).schema[0].dataType
        except Exception:
            return None
    return None


def _compare(c: Column, kind: T.DataType, op: str, value: Any) -> Column:
    """A comparison that is true or false, never null. Strings compare by their upper case, patterns too."""
    no = F.lit(False)
    if op == "~":
        pattern = str(value).upper()
        if len(pattern) > MAX_PATTERN:
            return no
        try:
            re.compile(pattern)
        except re.error:
            return no
        return F.coalesce(F.upper(c.cast("string")).rlike(pattern), no)
    if op == "contains":
        return F.coalesce(F.contains(F.upper(c.cast("string")), F.lit(str(value).upper())), no)
    numeric = isinstance(kind, T.NumericType)
    if isinstance(value, str) and numeric:
        # a number and a word: they are unequal and have no order
        return F.lit(op == "!=")
    left, right = (c, F.lit(value)) if numeric and not isinstance(value, str) else (F.upper(c.cast("string")), F.lit(str(value).upper()))
    if op == "=":
        return left.eqNullSafe(right)
    if op == "!=":
        return ~left.eqNullSafe(right)
    return F.coalesce({">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op], no)


def to_column(tree, df: DataFrame, counts: str = "entity_counts") -> Column:
    if isinstance(tree, Not):
        return ~to_column(tree.of, df, counts)
    if isinstance(tree, Both):
        a, b = to_column(tree.left, df, counts), to_column(tree.right, df, counts)
        return a & b if tree.op == "AND" else a | b
    if isinstance(tree, Compare):
        found = _field(df, tree.field)
        return _compare(found[0], found[1], tree.op, tree.value) if found else F.lit(tree.op == "!=")
    if tree.name == "missing":
        found = _field(df, tree.arg)
        if not found:
            return F.lit(True)
        c, kind = found
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return c.isNull() | (F.size(c) == 0)
        return c.isNull() | (F.trim(c) == "") if isinstance(kind, T.StringType) else c.isNull()
    if counts not in df.columns:
        n = F.lit(0)
    else:
        m = F.col(counts)
        upper = F.map_filter(m, lambda k, v: F.upper(k) == tree.arg.upper())
        # the exact key first, then any of its spellings
        n = F.coalesce(m[tree.arg], F.element_at(F.map_values(upper), F.when(F.size(upper) > 0, 1)), F.lit(0))
    return n > 0 if tree.name == "has" else _compare(n, T.LongType(), tree.op, tree.value)


def where(df: DataFrame, text: str) -> DataFrame:
    return df.where(to_column(parse(text), df))


def find(df: DataFrame, text: str | None = None, sort: str = "score", limit: int | None = None) -> DataFrame:
    """Filter, sort (score, entities and tier descending; path ascending), limit."""
    from tessera import taxonomy as X

    df = where(df, text) if text else df
    key = {"score": F.desc("risk_score"), "entities": F.desc("total_entities"), "tier": F.desc(X.tier_ordinal(F.col("risk_tier"))), "path": F.asc("file_path")}[sort]
    df = df.orderBy(key, "file_path")
    return df.limit(limit) if limit is not None else df
