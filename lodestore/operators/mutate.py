"""Mutations of class frames as set operations; each gives a new frame.

Frames never change, so a batch is atomic: its result is published only when all its
steps and checks have passed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import coerce
from ..schema import ID, TYPE, Registry, SchemaError, struct_of
from .expressions import Expr, Lowering


class ConstraintError(SchemaError):
    """Rows that break a constraint, with a sample of them."""


def require_none(found: DataFrame, what: str) -> None:
    if rows := found.take(3):
        raise ConstraintError(f"{what}: {rows}")


def _aligned(delta: DataFrame, frame: DataFrame) -> DataFrame:
    """``delta`` with the columns and types of ``frame``; unknown columns are errors."""
    if unknown := set(delta.columns) - set(frame.columns):
        raise SchemaError(f"unknown attributes {sorted(unknown)}")
    has = set(delta.columns)
    return delta.select(*((F.col(f"`{f.name}`") if f.name in has else F.lit(None)).cast(f.dataType).alias(f.name) for f in frame.schema))


def _only(frame: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    return frame.join(keys.select(ID), ID, how).select(*(F.col(f"`{c}`") for c in frame.columns))


def create(frame: DataFrame, delta: DataFrame) -> DataFrame:
    """Append new entities; ids that exist are refused by ``existing``."""
    return frame.unionByName(_aligned(delta, frame))


def existing(frame: DataFrame, delta: DataFrame) -> DataFrame:
    return _only(delta, frame, "left_semi")


def missing(frame: DataFrame, keys: DataFrame) -> DataFrame:
    return _only(keys, frame, "left_anti")


def replace(frame: DataFrame, delta: DataFrame) -> DataFrame:
    """Overwrite entities whole, and create those that don't exist."""
    return _only(frame, delta, "left_anti").unionByName(_aligned(delta, frame))


def _not_in(items: Column) -> Callable[[Column], Column]:
    return lambda x: ~F.coalesce(F.array_contains(items, x), F.lit(False))


#: A text list column of a merge's delta: attributes that go.
REMOVED = "_removed"


def merge(frame: DataFrame, delta: DataFrame) -> DataFrame:
    """Overwrite attributes that the delta has; lists get the elements they lack, in the
    delta's order; attributes that ``REMOVED`` lists become absent; entities that don't
    exist are created. One full outer join on the id, which the delta has once each."""
    gone = F.coalesce(F.col(REMOVED), F.array().cast("array<string>")) if REMOVED in delta.columns else None
    new = _aligned(delta.drop(REMOVED), frame) if gone is None else delta.select("*").drop(REMOVED)
    if gone is not None:
        marks = delta.select(F.col(f"`{ID}`").alias("_of"), gone.alias(REMOVED))
        new = _aligned(new, frame).join(marks, F.col(f"`{ID}`") == F.col("_of")).drop("_of")
    old, given = frame.alias("old"), new.alias("new")
    out = []
    for f in frame.schema:
        a, b = F.col(f"old.`{f.name}`"), F.col(f"new.`{f.name}`")
        if f.dataType.typeName() == "array":
            fresh = F.filter(F.array_distinct(b), _not_in(a))
            merged = F.when(a.isNull() | b.isNull(), F.coalesce(b, a)).otherwise(F.concat(a, fresh))
        else:
            merged = F.coalesce(b, a)
        if gone is not None and f.name not in (ID, TYPE):
            merged = F.when(~F.coalesce(F.array_contains(F.col(f"new.{REMOVED}"), f.name), F.lit(False)), merged)
        out.append(merged.alias(f.name))
    return old.join(given, F.col(f"old.`{ID}`") == F.col(f"new.`{ID}`"), "full_outer").select(*out)


def delete(frame: DataFrame, keys: DataFrame) -> DataFrame:
    return _only(frame, keys, "left_anti")


def delete_where(frame: DataFrame, registry: Registry, condition: Expr) -> DataFrame:
    return frame.where(~Lowering(registry).predicate(condition))


@dataclass(frozen=True)
class Change:
    """A change of one attribute: a name and its values, so that it can be logged."""

    op: str
    args: tuple = ()

    def __call__(self, a: Column) -> Column:
        values = [F.lit(v) for v in self.args]
        match self.op:
            case "put":
                return values[0]
            case "put_if":
                return F.when(a.isNull() | (a == values[0]), values[1]).otherwise(a)
            case "add":
                return F.when(a.isNull(), F.array(values[0])).when(F.array_contains(a, values[0]), a).otherwise(F.array_append(a, values[0]))
            case "remove":
                return F.lit(None)
            case "remove_if":
                return F.when(a == values[0], F.lit(None)).otherwise(a)
            case "remove_value":
                return F.filter(a, lambda x: ~x.eqNullSafe(values[0]))
        raise SchemaError(f"no change {self.op!r}")


Patch = Callable[[Column], Column]


def put(value: Any) -> Change:
    return Change("put", (value,))


def put_if(old: Any, new: Any) -> Change:
    """Set where the value is absent or ``old``; others stay."""
    return Change("put_if", (old, new))


def add(value: Any) -> Change:
    """Append to a list that lacks the value."""
    return Change("add", (value,))


def remove() -> Change:
    return Change("remove")


def remove_if(old: Any) -> Change:
    """Remove a value that equals ``old``; others stay."""
    return Change("remove_if", (old,))


def remove_value(old: Any) -> Change:
    """Drop equal elements of a list."""
    return Change("remove_value", (old,))


def patch(frame: DataFrame, changes: dict[str, Patch], where: Column | None = None) -> DataFrame:
    """Apply column changes to all rows, or to those that ``where`` accepts."""
    types = {f.name: f.dataType for f in frame.schema}
    if unknown := set(changes) - set(types):
        raise SchemaError(f"unknown attributes {sorted(unknown)}")
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    made = {}
    for name, change in changes.items():
        a = F.col(f"`{name}`")
        made[name] = F.when(hit, change(a).cast(types[name])).otherwise(a)
    return frame.withColumns(made)


def update_where(frame: DataFrame, registry: Registry, condition: Expr, values: dict[str, Any]) -> DataFrame:
    """Set attributes to literals, coerced on the driver, where the condition holds."""
    changes = {k: put(coerce(v, registry.attribute(k))) for k, v in values.items()}
    return patch(frame, changes, Lowering(registry).predicate(condition))


def patch_ids(frame: DataFrame, keys: DataFrame, changes: dict[str, Patch]) -> DataFrame:
    marked = frame.join(keys.select(F.col(f"`{ID}`").alias("_key")).distinct(), F.col(f"`{ID}`") == F.col("_key"), "left")
    return patch(marked, changes, F.col("_key").isNotNull()).drop("_key")


# Checks: each returns the rows that break a constraint.


def lacking_required(frame: DataFrame, registry: Registry, name: str) -> DataFrame:
    """Rows without a required scalar; a required list is empty rather than absent."""
    needed = [a for a, required in registry.members(name).items() if required and not registry.attribute(a).is_list]
    condition = F.lit(False)
    for a in needed:
        condition = condition | F.col(f"`{a}`").isNull()
    return frame.where(condition)


def mismatched(frame: DataFrame, keys: DataFrame, expected: dict[str, Any]) -> DataFrame:
    """Those of the rows that ``keys`` name where an attribute is present and isn't as
    expected: a patch that must replace or remove a given value may not be applied."""
    wrong = F.lit(False)
    for name, old in expected.items():
        wrong = wrong | F.coalesce(F.col(f"`{name}`") != F.lit(old), F.lit(False))
    return _only(frame, keys, "left_semi").where(wrong)


def repeated(frame: DataFrame, attribute: str) -> DataFrame:
    """Values of a unique attribute that several entities have, and how many."""
    a = F.col(f"`{attribute}`")
    return frame.where(a.isNotNull()).groupBy(a.alias("value")).agg(F.count("*").alias("n")).where("n > 1")


def dangling(frame: DataFrame, reference: str, targets: DataFrame) -> DataFrame:
    """Rows whose reference names no entity."""
    keys = targets.select(F.col(f"`{ID}`").alias("_target"))
    return frame.where(F.col(f"`{reference}`").isNotNull()).join(keys, F.col(f"`{reference}`") == F.col("_target"), "left_anti")


def wrong_class(frame: DataFrame, reference: str, targets: DataFrame, allowed: list[str]) -> DataFrame:
    """Rows whose reference names an entity of another class than exactly ``allowed``."""
    keys = targets.select(F.col(f"`{ID}`").alias("_target"), F.col(f"`{TYPE}`").alias("_type"))
    joined = frame.join(keys, F.col(f"`{reference}`") == F.col("_target"))
    return joined.where(~F.coalesce(F.col("_type").isin(allowed), F.lit(False))).drop("_target", "_type")


def validate(frame: DataFrame, registry: Registry, name: str, entities: DataFrame, ids: list[str] | None = None) -> None:
    """Raise ConstraintError if the class frame breaks a constraint; ``name`` is "" for
    entities without class. With ``ids`` only those entities have changed, and only they
    and what they may clash with are looked at."""
    changed = frame if ids is None else frame.where(F.col(f"`{ID}`").isin(ids))
    if name:
        if set(frame.columns) - set(struct_of(registry, name).names) and registry.entity_class(name).strict:
            raise SchemaError(f"{name} is strict")
        require_none(lacking_required(changed, registry, name), "required attributes are absent")
    for a in (registry.attribute(x) for x in frame.columns):
        if a.name == ID or a.unique and a.index:
            values = changed.select(F.col(f"`{a.name}`").alias("_value"))
            near = entities if ids is None else entities.join(values, F.col(f"`{a.name}`") == F.col("_value"), "left_semi")
            require_none(repeated(near, a.name), f"{a.name} must be unique")
        if a.type == "ref" and a.name != ID:
            require_none(dangling(changed, a.name, entities), f"{a.name} names no entity")
            if a.classes:
                require_none(wrong_class(changed, a.name, entities, list(a.classes)), f"{a.name} names a wrong class")
