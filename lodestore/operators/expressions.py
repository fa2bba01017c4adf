"""Predicates with two-valued, absent-aware comparison, lowered to Columns.

Absent (null) equals absent. In the order of values an id comes before absent, absent
before all else, and different kinds compare by rank; a comparison never fails. What
can be decided from declared types is decided here, so that the rest reaches the scan
in a form that Catalyst pushes down.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import coerce, natural_key
from ..schema import RANKS, TYPE, Attribute, Registry, SchemaError


@dataclass(frozen=True)
class Expr:
    op: str
    args: tuple

    def __and__(self, other):
        return Expr("and", (self, other))

    def __or__(self, other):
        return Expr("or", (self, other))

    def __invert__(self):
        return Expr("not", (self,))


def _of(x: Any) -> Expr:
    return x if isinstance(x, Expr) else Expr("literal", (x,))


def attr(name: str) -> Expr:
    return Expr("attr", (name,))


def literal(value: Any) -> Expr:
    return Expr("literal", (value,))


def ident(name: str) -> Expr:
    """The id of the entity with this ident; ``select.run`` looks it up."""
    return Expr("ident", (name,))


def list_of(*items: Any) -> Expr:
    return Expr("list", tuple(map(_of, items)))


def _binary(op: str):
    def build(left: Any, right: Any) -> Expr:
        return Expr(op, (_of(left), _of(right)))

    build.__name__ = op
    return build


eq, neq, lt, lte, gt, gte, in_, contains, starts_with = (_binary(x) for x in ("eq", "neq", "lt", "lte", "gt", "gte", "in", "contains", "starts_with"))


def between(x: Any, low: Any, high: Any) -> Expr:
    """Both ends included."""
    return gte(x, low) & lte(x, high)


def regex(left: Any, pattern: str, ignore_case: bool = False) -> Expr:
    return Expr("regex", (_of(left), pattern, ignore_case))


def if_(condition: Expr, then: Any, other: Any) -> Expr:
    return Expr("if", (condition, _of(then), _of(other)))


def is_null(x: Any) -> Expr:
    return eq(x, None)


def is_not_null(x: Any) -> Expr:
    return neq(x, None)


def is_class(name: str) -> Expr:
    return eq(attr(TYPE), name)


def inherits(name: str) -> Expr:
    return Expr("inherits", (name,))


def all_of(*parts: Expr) -> Expr:
    return reduce(lambda a, b: a & b, parts)


def any_of(*parts: Expr) -> Expr:
    return reduce(lambda a, b: a | b, parts)


def _literal_kind(value: Any) -> str:
    match value:
        case None:
            return "null"
        case bool():
            return "bool"
        case str():
            return "string"
        case bytes():
            return "bytes"
        case list() | tuple():
            return "list"
    return "time" if hasattr(value, "isoformat") else "num"


@dataclass
class Value:
    column: Column
    kind: str
    constant: Any = None
    is_constant: bool = False
    attribute: Attribute | None = None

    @property
    def absent(self) -> Column | None:
        """A test for absence, or None where the value can't be absent."""
        if self.is_constant:
            return F.lit(True) if self.constant is None else None
        return self.column.isNull()


class Lowering:
    """Lowers expressions for one registry. ``natural`` orders strings naturally."""

    def __init__(self, registry: Registry, natural: bool = True):
        self.registry, self.natural = registry, natural

    def value(self, e: Expr) -> Value:
        if e.op == "attr":
            a = self.registry.attribute(e.args[0])
            return Value(F.col(f"`{a.name}`"), a.kind, attribute=a)
        if e.op == "literal":
            v = e.args[0]
            column = F.array(*map(F.lit, v)) if isinstance(v, list | tuple) else F.lit(v)
            return Value(column, _literal_kind(v), v, True)
        if e.op == "list":
            return Value(F.array(*(self.value(x).column for x in e.args)), "list")
        if e.op == "ident":
            raise SchemaError(f"{e.args[0]!r} must be looked up before it is lowered")
        if e.op == "if":
            then, other = self.value(e.args[1]), self.value(e.args[2])
            if then.kind != other.kind and "null" not in (then.kind, other.kind):
                raise SchemaError("both branches of a condition need one kind")
            return Value(F.when(self.predicate(e.args[0]), then.column).otherwise(other.column), then.kind if then.kind != "null" else other.kind)
        return Value(self.predicate(e), "bool")

    def pair(self, left: Expr, right: Expr) -> tuple[Value, Value]:
        """Both sides; a text literal beside an id is taken as an id, and a literal
        beside a moment as a moment."""
        a, b = self.value(left), self.value(right)
        for x, y in ((a, b), (b, a)):
            if x.attribute and x.kind in ("id", "time") and y.is_constant and y.kind not in ("null", "list"):
                try:
                    y.constant = coerce(y.constant, x.attribute)
                    y.column, y.kind = F.lit(y.constant), x.kind
                except SchemaError:
                    pass
        return a, b

    def equal(self, a: Value, b: Value) -> Column:
        if a.kind == b.kind or "null" in (a.kind, b.kind):
            return a.column.eqNullSafe(b.column)
        absent = [x.absent for x in (a, b)]
        return F.lit(False) if any(x is None for x in absent) else absent[0] & absent[1]

    def less(self, a: Value, b: Value, or_equal: bool) -> Column:
        ra, rb, none = RANKS[a.kind], RANKS[b.kind], RANKS["null"]
        if a.kind == b.kind and a.kind != "null":
            x, y = (natural_key(a.column), natural_key(b.column)) if a.kind == "string" and self.natural else (a.column, b.column)
            present = x <= y if or_equal else x < y
        else:
            present = F.lit(ra < rb or (or_equal and ra == rb))
        terms = []
        if "null" not in (a.kind, b.kind):
            sides = [x.absent for x in (a, b) if x.absent is not None]
            known = reduce(lambda p, q: p & q, (~s for s in sides)) if sides else None
            terms.append(present if known is None or a.kind == b.kind else known & present)
        if a.absent is not None and b.kind != "null" and none < rb:
            terms.append(a.absent & ~b.absent if b.absent is not None else a.absent)
        if b.absent is not None and a.kind != "null" and ra < none:
            terms.append(b.absent & ~a.absent if a.absent is not None else b.absent)
        if or_equal and a.absent is not None and b.absent is not None:
            terms.append(a.absent & b.absent)
        return reduce(lambda p, q: p | q, terms) if terms else F.lit(False)

    def predicate(self, e: Expr) -> Column:
        """Never null: exactly true or false."""
        return F.coalesce(self.filter(e), F.lit(False))

    def filter(self, e: Expr) -> Column:
        """For the position of a filter: null counts as false, and the form is one that
        the scan can take over."""
        match e.op:
            case "and":
                return self.filter(e.args[0]) & self.filter(e.args[1])
            case "or":
                return self.filter(e.args[0]) | self.filter(e.args[1])
            case "not":
                return ~self.predicate(e.args[0])
            case "eq" | "neq":
                same = self.equal(*self.pair(*e.args))
                return same if e.op == "eq" else ~same
            case "lt" | "lte":
                return self.less(*self.pair(*e.args), e.op == "lte")
            case "gt" | "gte":
                return self.less(*reversed(self.pair(*e.args)), e.op == "gte")
            case "in":
                return self._in(*e.args)
            case "contains":
                a, b = self.value(e.args[0]), self.value(e.args[1])
                if a.kind == b.kind == "string":
                    return F.contains(a.column, b.column)
                return F.arrays_overlap(a.column, b.column) if a.kind == b.kind == "list" else F.lit(False)
            case "starts_with":
                a, b = self.value(e.args[0]), self.value(e.args[1])
                return F.startswith(a.column, b.column) if a.kind == b.kind == "string" else F.lit(False)
            case "regex":
                return self._regex(*e.args)
            case "inherits":
                return F.col(f"`{TYPE}`").isin(sorted(self.registry.family(e.args[0])))
            case _:
                v = self.value(e)
                return v.column if v.kind == "bool" else F.lit(False)

    def _in(self, left: Expr, right: Expr) -> Column:
        if right.op == "list":
            return reduce(lambda p, q: p | q, (self.equal(*self.pair(left, x)) for x in right.args), F.lit(False))
        a, b = self.value(left), self.value(right)
        if b.kind != "list":
            return F.lit(False)
        if not b.is_constant:
            return F.array_contains(b.column, a.column)
        items = [v for v in b.constant if v is not None and _literal_kind(v) == ("string" if a.kind in ("string", "id") else a.kind)]
        found = a.column.isin(items) if items else F.lit(False)
        return found | a.column.isNull() if None in b.constant else found

    def _regex(self, left: Expr, pattern: str, ignore_case: bool) -> Column:
        if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
            raise SchemaError("look-around and back-references aren't supported")
        a = self.value(left)
        return a.column.rlike(("(?iuU)" if ignore_case else "(?U)") + pattern) if a.kind == "string" else F.lit(False)
