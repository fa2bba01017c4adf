"""Schema migrations: a new registry and new class frames."""

from __future__ import annotations

import datetime
import inspect
import types
import uuid
from dataclasses import dataclass, field, replace
from typing import Annotated, Any, get_args, get_origin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import coerce
from ..operators.mutate import repeated, require_none
from ..operators.select import entities
from ..schema import BUILTIN, Attribute, EntityClass, Registry, SchemaError


@dataclass
class State:
    registry: Registry = field(default_factory=Registry)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    applied: tuple[str, ...] = ()


def create_attribute(state: State, a: Attribute) -> State:
    return replace(state, registry=state.registry.with_attribute(a))


def upsert_attribute(state: State, a: Attribute) -> State:
    """Create; the same again changes nothing, another definition is refused."""
    old = state.registry.attributes.get(a.name)
    if old is not None and old != a:
        raise SchemaError(f"attribute {a.name!r} exists with another definition")
    return state if old else create_attribute(state, a)


def change_type(state: State, name: str, new: Attribute) -> State:
    """A union may get more constants; a scalar may become a list of itself."""
    old = state.registry.attribute(name)
    if old.type == new.type and set(old.allowed) <= set(new.allowed) and old.allowed:
        return replace(state, registry=state.registry.with_changed(name, allowed=new.allowed))
    if new.type != f"list<{old.type}>":
        raise SchemaError(f"{old.type} can't become {new.type}")
    a = F.col(f"`{name}`")
    frames = {k: f.withColumn(name, F.when(a.isNotNull(), F.array(a))) if name in f.columns else f for k, f in state.frames.items()}
    return replace(state, registry=state.registry.with_changed(name, type=new.type), frames=frames)


def create_index(state: State, name: str, unique: bool) -> State:
    """Spark needs no index; a unique one is checked and then enforced on writes."""
    if unique and state.frames:
        require_none(repeated(entities(state.frames), name), f"{name} must be unique")
    return replace(state, registry=state.registry.with_changed(name, index=True, unique=unique))


def delete_index(state: State, name: str) -> State:
    return replace(state, registry=state.registry.with_changed(name, index=False, unique=False))


def delete_attribute(state: State, name: str) -> State:
    registry = state.registry.without_attribute(name)
    return replace(state, registry=registry, frames={k: f.drop(f"`{name}`" if name not in f.columns else name) for k, f in state.frames.items()})


def create_class(state: State, c: EntityClass) -> State:
    return replace(state, registry=state.registry.with_class(c))


def upsert_class(state: State, c: EntityClass) -> State:
    """Create; of an existing class the title and new optional attributes may change."""
    old = state.registry.classes.get(c.name)
    if old is None:
        return create_class(state, c)
    new = {k: v for k, v in c.attributes.items() if k not in old.attributes}
    if any(new.values()) or replace(c, attributes=old.attributes, title=old.title) != old or old.attributes.items() - c.attributes.items():
        raise SchemaError(f"class {c.name!r} exists with another definition")
    return replace(state, registry=state.registry.with_class_set(c))


def add_attribute(state: State, cls: str, name: str, required: bool, default: Any = None) -> State:
    """A required attribute needs a default, which class and heirs get where it's absent."""
    c, a = state.registry.entity_class(cls), state.registry.attribute(name)
    if required and default is None:
        raise SchemaError("a required attribute needs a default")
    registry = state.registry.with_class_set(replace(c, attributes=c.attributes | {name: required}))
    value = F.lit(None if default is None else coerce(default, a)).cast(a.spark)
    frames = dict(state.frames)
    for k in registry.family(cls) & set(frames):
        have = F.col(f"`{name}`") if name in frames[k].columns else F.lit(None).cast(a.spark)
        frames[k] = frames[k].withColumn(name, F.coalesce(have, value))
    return replace(state, registry=registry, frames=frames)


def make_optional(state: State, cls: str, name: str) -> State:
    c = state.registry.entity_class(cls)
    return replace(state, registry=state.registry.with_class_set(replace(c, attributes=c.attributes | {name: False})))


def remove_attribute(state: State, cls: str, name: str, drop_values: bool = False) -> State:
    c = state.registry.entity_class(cls)
    registry = state.registry.with_class_set(replace(c, attributes={k: v for k, v in c.attributes.items() if k != name}))
    frames = dict(state.frames)
    if drop_values and cls in frames:
        frames[cls] = frames[cls].withColumn(name, F.lit(None).cast(registry.attribute(name).spark))
    return replace(state, registry=registry, frames=frames)


def delete_class(state: State, name: str) -> State:
    """The class and its own rows go; a class that others extend stays."""
    return replace(state, registry=state.registry.without_class(name), frames={k: f for k, f in state.frames.items() if k != name})


ACTIONS = {f.__name__: f for f in (create_attribute, upsert_attribute, change_type, create_index, delete_index, delete_attribute, create_class, upsert_class, add_attribute, make_optional, remove_attribute, delete_class)}


#: Python types of dataclass fields and the attribute types that hold them.
DECLARED = {bool: "bool", int: "int", float: "float", str: "string", bytes: "bytes", datetime.datetime: "datetime", uuid.UUID: "ref"}


def declared(cls: type, namespace: str) -> list[tuple]:
    """The actions that bring in the class that a dataclass declares: own fields are
    attributes, ``X | None`` is optional, ``list[X]`` a list, and base dataclasses are
    parents, which must be declared before. ``Annotated[X, {"unique": True}]`` gives more of
    an attribute's fields, ``name`` included."""
    actions, own = [], {}
    for name, hint in inspect.get_annotations(cls, eval_str=True).items():
        hint, *extra = get_args(hint) if get_origin(hint) is Annotated else (hint,)
        parts = get_args(hint) if isinstance(hint, types.UnionType) else (hint,)
        given = [p for p in parts if p is not types.NoneType]
        many = get_origin(given[0]) is list
        inner = get_args(given[0])[0] if many else given[0]
        if len(given) != 1 or inner not in DECLARED:
            raise SchemaError(f"{hint!r} of {name!r} can't be an attribute's type")
        stated = {"name": f"{namespace}/{name}", "type": f"list<{DECLARED[inner]}>" if many else DECLARED[inner]}
        for fields in extra:
            stated |= fields
        a = Attribute(**stated)
        actions.append(("upsert_attribute", a))
        own[a.name] = len(given) == len(parts)
    parents = tuple(f"{namespace}/{b.__name__}" for b in cls.__bases__ if hasattr(b, "__dataclass_fields__"))
    return [*actions, ("upsert_class", EntityClass(f"{namespace}/{cls.__name__}", own, parents))]


def migrate(state: State, name: str, actions: list[tuple]) -> State:
    """Apply (action, *arguments) in order; all or nothing. A name is used once."""
    if name in state.applied:
        raise SchemaError(f"migration {name!r} was applied")
    for action, *args in actions:
        state = ACTIONS[action](state, *args)
    return replace(state, applied=(*state.applied, name))


def unify(migrations: list[tuple[str, list[tuple]]], name: str) -> tuple[str, list[tuple]]:
    """One migration that creates what a list of (name, actions) leaves of attributes and
    classes. Values aren't touched: it is for a database without entities. A class that
    an attribute of its own refers to is created without it and gets it later."""
    state = State()
    for each, actions in migrations:
        state = migrate(state, each, actions)
    attributes = [a for a in state.registry.attributes.values() if a not in BUILTIN]
    classes, known, out = list(state.registry.classes.values()), {a.name for a in BUILTIN}, []
    while attributes or classes:
        if ready := [a for a in attributes if set(a.classes) <= known]:
            attributes = [a for a in attributes if a not in ready]
            out += [("create_attribute", a) for a in ready]
        elif ready := [c for c in classes if {*c.extends, *c.attributes} <= known]:
            classes = [c for c in classes if c not in ready]
            out += [("upsert_class" if ("create_class", c.name) in {(x, y.name) for x, y in out} else "create_class", c) for c in ready]
        elif ready := [c for c in classes if set(c.extends) <= known and c.name not in known]:
            if needed := [k for k, required in ready[0].attributes.items() if required and k not in known]:
                raise SchemaError(f"{', '.join(needed)} of {ready[0].name} refer back to it and are required")
            out.append(("create_class", replace(ready[0], attributes={k: v for k, v in ready[0].attributes.items() if k in known})))
        known |= {x.name for _, x in out}
    return name, out
