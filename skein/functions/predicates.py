"""The sample predicate algebra: conditions on a sample's id and its visible inline values.

Predicates are two-valued: a value that is missing, deleted or stored elsewhere never matches, so Not returns
its sample. compile() gives a boolean Column that is never null, which Catalyst pushes to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Admission limits of a predicate.
MAX_DEPTH, MAX_NODES, MAX_IDS = 32, 1024, 10_000


class Predicate:
    def __and__(self, other: Predicate) -> And:
        return And((self, other))

    def __or__(self, other: Predicate) -> Or:
        return Or((self, other))

    def __invert__(self) -> Not:
        return Not(self)


@dataclass(frozen=True)
class Prefix(Predicate):
    value: bytes


@dataclass(frozen=True)
class Range(Predicate):
    """start <= id < end, in unsigned byte order."""

    start: bytes
    end: bytes


@dataclass(frozen=True)
class Explicit(Predicate):
    ids: tuple[bytes, ...]


@dataclass(frozen=True)
class Keyword(Predicate):
    """Some inline value contains the bytes."""

    value: bytes


@dataclass(frozen=True)
class FieldMatch(Predicate):
    field: str
    value: bytes


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


#: Every sample.
ALL = Not(Explicit(()))


class InvalidPredicate(ValueError):
    pass


def _children(p: Predicate) -> tuple[Predicate, ...]:
    return p.parts if isinstance(p, And | Or) else (p.part,) if isinstance(p, Not) else ()


def fields_of(p: Predicate) -> set[str]:
    """The fields whose values the predicate reads by name."""
    own = {p.field} if isinstance(p, FieldMatch) else set()
    return own.union(*(fields_of(c) for c in _children(p)))


def reads_all_fields(p: Predicate) -> bool:
    return isinstance(p, Keyword) or any(reads_all_fields(c) for c in _children(p))


def explicit_ids(p: Predicate) -> list[bytes]:
    own = list(p.ids) if isinstance(p, Explicit) else []
    return own + [i for c in _children(p) for i in explicit_ids(c)]


def validate(p: Predicate, fields: set[str] | None = None, version: int = 2) -> None:
    """Raises InvalidPredicate for what a reader of that version rejects. fields: the schema's, if known."""
    nodes = 0

    def visit(q: Predicate, depth: int) -> None:
        nonlocal nodes
        nodes += 1
        if depth > MAX_DEPTH or nodes > MAX_NODES:
            raise InvalidPredicate("the predicate is too large")
        if isinstance(q, Prefix) and not q.value:
            raise InvalidPredicate("an empty prefix")
        if isinstance(q, Range) and (not q.start or q.start >= q.end):
            raise InvalidPredicate("an empty range")
        if isinstance(q, Explicit) and version == 1 and (not all(q.ids) or len(set(q.ids)) < len(q.ids)):
            raise InvalidPredicate("empty or repeated ids")
        if isinstance(q, Keyword) and not q.value:
            raise InvalidPredicate("an empty keyword")
        if isinstance(q, FieldMatch):
            if not q.field or (version == 1 and not q.value):
                raise InvalidPredicate("an empty field or value")
            if fields is not None and q.field not in fields:
                raise InvalidPredicate(f"no field {q.field}")
        if isinstance(q, And | Or) and not q.parts:
            raise InvalidPredicate("an empty list of predicates")
        for c in _children(q):
            visit(c, depth + 1)

    visit(p, 1)
    if len(explicit_ids(p)) > MAX_IDS:
        raise InvalidPredicate("too many explicit ids")


def successor(prefix: bytes) -> bytes | None:
    """The least byte string above all that begin with the prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def has_prefix(key: Column, prefix: bytes) -> Column:
    """As a key range, which scans can skip by, and exactly."""
    out = key.startswith(F.lit(prefix)) & (key >= F.lit(prefix))
    end = successor(prefix)
    return out if end is None else out & (key < F.lit(end))


def compile(p: Predicate, sample_id: Column, values: dict[str, Column]) -> Column:  # noqa: A001
    """The predicate over a binary id and the binary inline values by field; null: nothing visible."""
    if isinstance(p, Prefix):
        out = has_prefix(sample_id, p.value)
    elif isinstance(p, Range):
        out = (sample_id >= F.lit(p.start)) & (sample_id < F.lit(p.end))
    elif isinstance(p, Explicit):
        out = sample_id.isin([F.lit(i) for i in p.ids]) if p.ids else F.lit(False)
    elif isinstance(p, Keyword):
        out = reduce(or_, (F.coalesce(F.contains(v, F.lit(p.value)), F.lit(False)) for v in values.values()), F.lit(False))
    elif isinstance(p, FieldMatch):
        out = values[p.field] == F.lit(p.value) if p.field in values else F.lit(False)
    elif isinstance(p, And | Or):
        return reduce(and_ if isinstance(p, And) else or_, (compile(c, sample_id, values) for c in p.parts))
    elif isinstance(p, Not):
        return ~compile(p.part, sample_id, values)
    else:
        raise TypeError(p)
    return F.coalesce(out, F.lit(False))
