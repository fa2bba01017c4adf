"""Selection over entities: filter, sort, offset, limit, count and expansion of references."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import natural_key
from ..schema import COUNT, ID, IDENT, Registry, SchemaError
from .expressions import Expr, Lowering, attr, literal


def entities(frames: dict[str, DataFrame]) -> DataFrame:
    """All classes as one sparse frame; Catalyst prunes branches by class and attribute."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames.values())


@dataclass
class Select:
    """``limit`` 0 is no limit; ``count`` counts what is left after offset and limit."""

    where: Expr | None = None
    order: list[tuple[Expr | str, bool]] = field(default_factory=list)
    offset: int = 0
    limit: int = 0
    count: bool = False


def _idents(e) -> set[str]:
    if not isinstance(e, Expr):
        return set()
    return {e.args[0]} if e.op == "ident" else set().union(*map(_idents, e.args))


def _named(e, ids: dict[str, str]):
    if not isinstance(e, Expr):
        return e
    return literal(ids[e.args[0]]) if e.op == "ident" else Expr(e.op, tuple(_named(x, ids) for x in e.args))


def resolve(source: DataFrame, query: Select) -> Select:
    """``query`` with the ids of the entities that it names by ident: one lookup for all,
    which gives a row per name. An ident that no entity has is an error."""
    parts = [query.where, *(k for k, _ in query.order)]
    names = set().union(*map(_idents, parts))
    if not names:
        return query
    found = source.where(F.col(f"`{IDENT}`").isin(sorted(names))).groupBy(f"`{IDENT}`").agg(F.min(f"`{ID}`")).collect()
    ids = dict(map(tuple, found))
    if lacking := names - set(ids):
        raise SchemaError(f"no entity has the ident {', '.join(sorted(lacking))}")
    return replace(query, where=_named(query.where, ids), order=[(_named(k, ids), d) for k, d in query.order])


def run(source: DataFrame, registry: Registry, query: Select, natural: bool = True) -> DataFrame:
    """The result of ``query``. Ascending order puts absent values first, but last for
    references; the id breaks ties, so pages are stable."""
    lower, out, query = Lowering(registry, natural), source, resolve(source, query)
    if query.where is not None:
        out = out.where(lower.filter(query.where))
    if query.order:
        keys = []
        for key, descending in query.order:
            v = lower.value(attr(key) if isinstance(key, str) else key)
            column = natural_key(v.column) if v.kind == "string" and natural else v.column
            if v.kind == "id":
                keys.append(column.desc_nulls_first() if descending else column.asc_nulls_last())
            else:
                keys.append(column.desc_nulls_last() if descending else column.asc_nulls_first())
        out = out.orderBy(*keys, F.col(f"`{ID}`"))
    if query.offset:
        out = out.offset(query.offset)
    if query.limit:
        out = out.limit(query.limit)
    return out.agg(F.count(F.lit(1)).alias(COUNT)) if query.count else out


def by_id(source: DataFrame, key: str) -> DataFrame:
    return source.where(F.col(f"`{ID}`") == key)


def expand(left: DataFrame, right: DataFrame, reference: str, name: str) -> DataFrame:
    """Each row with the entity that ``reference`` names as struct ``name`` (null if none)."""
    target = right.select(F.struct("*").alias(name))
    return left.join(target, F.col(f"`{reference}`") == F.col(name)[ID], "left")


def as_maps(frame: DataFrame):
    """Rows as dicts without absent attributes, one partition at a time."""
    for row in frame.toLocalIterator():
        yield {k: v for k, v in row.asDict(recursive=True).items() if v is not None}


@dataclass(frozen=True)
class Item:
    """An entity and those that it was expanded to, as maps without absent attributes."""

    data: dict[str, Any]
    joins: dict[str, dict[str, Any]] = field(default_factory=dict)

    def flat(self) -> list[dict[str, Any]]:
        return [self.data, *self.joins.values()]


def items(frame: DataFrame, *joined: str):
    """Rows as items; ``joined`` names the structs that ``expand`` added."""
    for data in as_maps(frame):
        joins = {n: {k: v for k, v in data.pop(n).items() if v is not None} for n in joined if n in data}
        yield Item(data, joins)
