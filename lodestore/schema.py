"""Attributes, classes and their registry: plain driver-side metadata."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

#: Type names of attributes and the Spark types that hold them.
SPARK_TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "int": T.LongType(), "uint": T.DecimalType(20, 0), "float": T.DoubleType(), "string": T.StringType(),
    "bytes": T.BinaryType(), "datetime": T.TimestampNTZType(), "url": T.StringType(), "ref": T.StringType(), "ident": T.StringType(),
}
#: Kinds order values of different types: the smaller rank sorts first; absent is 1.
KINDS = {"bool": "bool", "int": "num", "uint": "num", "float": "num", "string": "string", "url": "string", "ident": "string", "bytes": "bytes", "ref": "id", "datetime": "time"}
RANKS = {"id": 0, "null": 1, "bool": 2, "num": 3, "time": 3, "string": 4, "bytes": 5, "list": 6, "map": 7}
_IDENT = re.compile(r"[A-Za-z0-9._]+/[A-Za-z0-9._]+\Z")
ID, TYPE, IDENT, COUNT = "core/id", "core/type", "core/ident", "core/count"


class SchemaError(ValueError):
    """A schema or data change that the registry refuses."""


def check_ident(name: str) -> str:
    if not _IDENT.match(name) or len(name) > 50:
        raise SchemaError(f"{name!r} isn't namespace/name of letters, digits, dots and underscores, 50 at most")
    return name


@dataclass(frozen=True)
class Attribute:
    """A globally typed attribute. ``type`` is a type name or ``list<name>``; ``allowed``
    are the constants of a union, ``classes`` those that a reference may point to."""

    name: str
    type: str
    unique: bool = False
    index: bool = False
    classes: tuple[str, ...] = ()
    allowed: tuple = ()
    title: str = ""

    @property
    def element(self) -> str:
        return self.type[5:-1] if self.is_list else self.type

    @property
    def is_list(self) -> bool:
        return self.type.startswith("list<")

    @property
    def kind(self) -> str:
        return "list" if self.is_list else KINDS[self.type]

    @property
    def spark(self) -> T.DataType:
        inner = SPARK_TYPES[self.element]
        return T.ArrayType(inner) if self.is_list else inner


@dataclass(frozen=True)
class EntityClass:
    """A class: own attributes (name -> required), parents, and whether others are refused."""

    name: str
    attributes: dict[str, bool] = field(default_factory=dict)
    extends: tuple[str, ...] = ()
    strict: bool = False
    title: str = ""


BUILTIN = (
    Attribute(ID, "ref"), Attribute(IDENT, "string", unique=True, index=True), Attribute("core/title", "string"), Attribute("core/description", "string"),
    Attribute(TYPE, "ident", index=True), Attribute(COUNT, "uint"),
)


class Registry:
    """All attributes and classes; every change gives a new registry."""

    def __init__(self, attributes: dict[str, Attribute] | None = None, classes: dict[str, EntityClass] | None = None):
        self.attributes = attributes if attributes is not None else {a.name: a for a in BUILTIN}
        self.classes = classes or {}

    def attribute(self, name: str) -> Attribute:
        if name not in self.attributes:
            raise SchemaError(f"no attribute {name!r}")
        return self.attributes[name]

    def entity_class(self, name: str) -> EntityClass:
        if name not in self.classes:
            raise SchemaError(f"no class {name!r}")
        return self.classes[name]

    def family(self, name: str) -> set[str]:
        """The class and all that inherit from it."""
        self.entity_class(name)
        found, grown = {name}, True
        while grown:
            more = {c.name for c in self.classes.values() if set(c.extends) & found} - found
            grown = bool(more)
            found |= more
        return found

    def members(self, name: str) -> dict[str, bool]:
        """Own and inherited attributes with whether they are required."""
        own, out = self.entity_class(name), {}
        for parent in own.extends:
            out |= self.members(parent)
        return out | own.attributes

    def with_attribute(self, a: Attribute) -> Registry:
        check_ident(a.name)
        if a.element not in SPARK_TYPES:
            raise SchemaError(f"{a.type!r} can't be an attribute's type")
        if a.name in self.attributes:
            raise SchemaError(f"attribute {a.name!r} exists")
        for c in a.classes:
            self.entity_class(c)
        return Registry(self.attributes | {a.name: a}, self.classes)

    def with_changed(self, name: str, **changes) -> Registry:
        return Registry(self.attributes | {name: replace(self.attribute(name), **changes)}, self.classes)

    def without_attribute(self, name: str) -> Registry:
        self.attribute(name)
        if users := [c.name for c in self.classes.values() if name in c.attributes]:
            raise SchemaError(f"attribute {name!r} is used by {', '.join(users)}")
        return Registry({k: v for k, v in self.attributes.items() if k != name}, self.classes)

    def with_class(self, c: EntityClass) -> Registry:
        check_ident(c.name)
        if c.name in self.classes:
            raise SchemaError(f"class {c.name!r} exists")
        return self.with_class_set(c)

    def with_class_set(self, c: EntityClass) -> Registry:
        for parent in c.extends:
            self.entity_class(parent)
        for a in c.attributes:
            self.attribute(a)
        return Registry(self.attributes, self.classes | {c.name: c})

    def without_class(self, name: str) -> Registry:
        self.entity_class(name)
        if heirs := self.family(name) - {name}:
            raise SchemaError(f"class {name!r} is extended by {', '.join(sorted(heirs))}")
        return Registry(self.attributes, {k: v for k, v in self.classes.items() if k != name})

    def to_json(self) -> str:
        return json.dumps({"attributes": [asdict(a) for a in self.attributes.values()], "classes": [asdict(c) for c in self.classes.values()]})

    @classmethod
    def from_json(cls, text: str) -> Registry:
        data = json.loads(text)
        tup = lambda d, *keys: d | {k: tuple(d[k]) for k in keys}
        return cls(
            {d["name"]: Attribute(**tup(d, "classes", "allowed")) for d in data["attributes"]},
            {d["name"]: EntityClass(**tup(d, "extends")) for d in data["classes"]},
        )


def struct_of(registry: Registry, name: str) -> T.StructType:
    """The frame schema of a class: id, type and its attributes."""
    fields = [T.StructField(ID, T.StringType()), T.StructField(TYPE, T.StringType())]
    return T.StructType(fields + [T.StructField(a, registry.attribute(a).spark) for a in registry.members(name) if a not in (ID, TYPE)])
