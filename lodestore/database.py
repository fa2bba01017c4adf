"""The client's view: a registry, class frames, and mutations as new snapshots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.values import coerce
from .operators import mutate, select
from .operators.expressions import Expr, attr, eq
from .plans import migrate as plans
from .schema import ID, IDENT, TYPE, Registry, SchemaError, struct_of
from .sources import store


class NotFound(SchemaError):
    """No such entity."""


class Database:
    """Entities by class; those without class are the frame named "". With ``path`` every
    commit is written there and ``open`` gives the database again. Without it frames are
    plans, which are cut by a checkpoint at every commit if ``spark.checkpoint.dir`` is set.

    An entity has one id and one class: creating an id that any class has is refused, a
    replacement moves it, and a merge into another class than its own is refused.
    """

    def __init__(self, spark: SparkSession, state: plans.State | None = None, path: str | None = None, version: int = 0, places: dict[str, str] | None = None):
        self.spark, self.state, self.path, self.version, self.places = spark, state or plans.State(), path, version, places or {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> Database:
        """The database in a folder, as of its last commit or of ``version``; an empty one
        where there is none. Commits to an old version are refused."""
        last = store.head(spark, path, version)
        if last is None:
            return cls(spark, path=path)
        frames = {k: store.read_frame(spark, v) for k, v in last["frames"].items()}
        state = plans.State(Registry.from_json(last["registry"]), frames, tuple(last["applied"]))
        return cls(spark, state, path, last["version"], dict(last["frames"]))

    @classmethod
    def rebuild(cls, spark: SparkSession, source: str, path: str | None = None) -> Database:
        """A database from the events of another's folder, commit by commit."""
        made = cls(spark, path=path)
        for row in store.commits(spark, source).orderBy("version").select("events").toLocalIterator():
            made.transact([tuple(e) for e in store.decode(json.loads(row["events"]))])
        return made

    def events(self) -> DataFrame:
        """The log: version, number in the commit, operation and its arguments as JSON."""
        listed = F.from_json("events", T.ArrayType(T.ArrayType(T.StringType())))
        rows = store.commits(self.spark, self.path).select("version", F.posexplode(listed).alias("number", "event"))
        return rows.select("version", "number", F.col("event")[0].alias("op"), F.slice("event", 2, F.size("event")).alias("arguments"))

    @property
    def registry(self):
        return self.state.registry

    def migrations(self) -> tuple[str, ...]:
        return self.state.applied

    def entities(self) -> DataFrame:
        return self._entities(self.state.frames)

    def _entities(self, frames: dict[str, DataFrame]) -> DataFrame:
        """All entities with all attributes, also those that no class has."""
        some = select.entities(frames) if frames else self.spark.createDataFrame([], f"`{ID}` string, `{TYPE}` string, `{IDENT}` string")
        return self._full(some)

    def frame(self, name: str) -> DataFrame:
        return self._frame(self.state.frames, name)

    def _frame(self, frames: dict[str, DataFrame], name: str) -> DataFrame:
        if name not in frames:
            return self.spark.createDataFrame([], struct_of(self.registry, name) if name else T.StructType([T.StructField(ID, T.StringType()), T.StructField(TYPE, T.StringType())]))
        return frames[name]

    def select(self, query: select.Select) -> DataFrame:
        return select.run(self.entities(), self.registry, query)

    def page(self, query: select.Select, number: int, size: int) -> list[dict[str, Any]]:
        """The entities of one page as maps; pages count from 0."""
        return list(select.as_maps(self.select(select.Select(query.where, query.order, query.offset + number * size, size))))

    def entity(self, key: str) -> dict[str, Any]:
        """By id or ident; NotFound if there is none."""
        return self._entity(self.state.frames, key)

    def _entity(self, frames: dict[str, DataFrame], key: str) -> dict[str, Any]:
        try:
            where = eq(attr(ID), str(uuid.UUID(key)))
        except ValueError:
            where = eq(attr(IDENT), key)
        for found in select.as_maps(select.run(self._entities(frames), self.registry, select.Select(where, limit=1))):
            return found
        raise NotFound(key)

    def migrate(self, name: str, actions: list[tuple]) -> None:
        self.transact([("migrate", name, actions)])

    def rows(self, name: str, rows: list[dict[str, Any]], removals: bool = False) -> DataFrame:
        """Literal entities of a class, or of none (""), coerced and checked; lists that are
        required and absent are empty, and a missing id is a new one. With ``removals``
        attributes that are given as None are listed in ``mutate.REMOVED``."""
        if name:
            schema, members = struct_of(self.registry, name), self.registry.members(name)
        else:
            given = sorted({k for row in rows for k in row} - {ID, TYPE})
            schema, members = T.StructType([T.StructField(ID, T.StringType()), T.StructField(TYPE, T.StringType()), *(T.StructField(a, self.registry.attribute(a).spark) for a in given)]), {}
        out = []
        for row in rows:
            given = {k: coerce(v, self.registry.attribute(k)) for k, v in row.items() if v is not None}
            if unknown := set(row) - set(schema.names):
                raise SchemaError(f"{sorted(unknown)} aren't attributes of {name or 'any'}")
            for k, required in members.items():
                if required and k not in given and self.registry.attribute(k).is_list:
                    given[k] = []
            values = tuple({ID: str(uuid.uuid4()), TYPE: name or None, **given}.get(c) for c in schema.names)
            out.append((*values, [k for k, v in row.items() if v is None]) if removals else values)
        if removals:
            schema = T.StructType([*schema.fields, T.StructField(mutate.REMOVED, T.ArrayType(T.StringType()))])
        return self.spark.createDataFrame(out, schema)

    def _identified(self, rows: list[dict[str, Any]], fold: str) -> list[dict[str, Any]]:
        """Rows with ids, one for each id: a repeated id is refused ("create"), the last row
        counts ("replace"), or later rows add to earlier ones ("merge")."""
        out: dict[str, dict[str, Any]] = {}
        for row in rows:
            key = str(uuid.UUID(str(row[ID]))) if row.get(ID) else str(uuid.uuid4())
            if key in out and fold == "create":
                raise mutate.ConstraintError(f"{key} is created twice")
            if key in out and fold == "merge":
                lists = {k: [*coerce(out[key][k], self.registry.attribute(k)), *coerce(v, self.registry.attribute(k))] for k, v in row.items() if out[key].get(k) is not None and v is not None and self.registry.attribute(k).is_list}
                row = out[key] | row | lists
            out[key] = row | {ID: key}
        return list(out.values())

    def _homes(self, frames: dict[str, DataFrame], ids: list[str]) -> dict[str, str]:
        """The classes of those of some ids that exist."""
        parts = [f.where(F.col(f"`{ID}`").isin(ids)).select(F.col(f"`{ID}`"), F.lit(name)) for name, f in frames.items()]
        found: dict[str, str] = {}
        for part in parts:
            found |= dict(map(tuple, part.collect()))
        return found

    def transact(self, events: list[tuple]) -> None:
        """Apply events in order, later ones seeing earlier ones; all or nothing. An event is
        the name of one of the methods below and its arguments."""
        before, state, logged = self.state, self.state, []
        try:
            for op, *args in events:
                if op == "migrate":
                    self.state = plans.migrate(self.state, args[0], [tuple(a) for a in args[1]])
                else:
                    if op in ("create", "replace", "merge"):
                        args = [args[0] or "", self._identified(args[1], op)]
                    frames, ids = getattr(self, f"_{op}")(dict(self.state.frames), *args)
                    everything = self._entities(frames)
                    for name, frame in frames.items():
                        if frame is not self.state.frames.get(name):
                            mutate.validate(frame, self.registry, name, everything, ids)
                    self.state = plans.State(self.registry, frames, self.state.applied)
                logged.append([op, *args])
            state = self._published(before, self.state, logged)
        except BaseException:
            self.state = before
            raise
        self.state = state

    def _published(self, before: plans.State, after: plans.State, events: list) -> plans.State:
        frames, places = dict(after.frames), {k: v for k, v in self.places.items() if k in after.frames}
        for name, frame in after.frames.items():
            if frame is before.frames.get(name):
                continue
            if self.path:
                places[name], frames[name] = store.write_frame(frame, self.path)
            elif self.spark.sparkContext.getCheckpointDir():
                frames[name] = frame.checkpoint()
        if self.path:
            store.append(self.spark, self.path, self.version + 1, events, after.registry.to_json(), places, after.applied)
            self.version, self.places = self.version + 1, places
        return plans.State(after.registry, frames, after.applied)

    def _wide(self, frames: dict[str, DataFrame], name: str, delta: DataFrame) -> DataFrame:
        """A frame with the delta's attributes: without class there is no fixed set."""
        frame = self._frame(frames, name)
        more = {} if name else {f.name: F.lit(None).cast(f.dataType) for f in delta.schema if f.name not in {*frame.columns, mutate.REMOVED}}
        return frame.withColumns(more) if more else frame

    def _create(self, frames, name, rows):
        delta, ids = self.rows(name, rows), [r[ID] for r in rows]
        if homes := self._homes(frames, ids):
            raise mutate.ConstraintError(f"entities exist: {sorted(homes)[:3]}")
        return frames | {name: mutate.create(self._wide(frames, name, delta), delta)}, ids

    def _load(self, frames, name, what):
        delta = store.read_frame(self.spark, what) if isinstance(what, str) else what
        mutate.require_none(mutate.existing(delta, self._entities(frames)), "entities exist")
        return frames | {name: mutate.create(self._wide(frames, name, delta), delta)}, None

    def _replace(self, frames, name, rows):
        delta, ids = self.rows(name, rows), [r[ID] for r in rows]
        for home in set(self._homes(frames, ids).values()) - {name}:
            frames[home] = mutate.delete(frames[home], delta)
        return frames | {name: mutate.replace(self._wide(frames, name, delta), delta)}, ids

    def _merge(self, frames, name, rows):
        delta, ids = self.rows(name, rows, removals=True), [r[ID] for r in rows]
        if others := {k: v for k, v in self._homes(frames, ids).items() if v != name}:
            raise mutate.ConstraintError(f"entities of another class: {others}")
        return frames | {name: mutate.merge(self._wide(frames, name, delta), delta)}, ids

    def _home(self, frames: dict[str, DataFrame], key: str) -> tuple[str, str, DataFrame]:
        found = self._entity(frames, key)
        return found.get(TYPE, ""), found[ID], self.spark.createDataFrame([(found[ID],)], f"`{ID}` string")

    def _patch(self, frames, key, changes, expected=None):
        name, id_, keys = self._home(frames, key)
        if expected:
            mutate.require_none(mutate.mismatched(frames[name], keys, expected), "values aren't as expected")
        return frames | {name: mutate.patch_ids(frames[name], keys, changes)}, [id_]

    def _delete(self, frames, key):
        name, id_, keys = self._home(frames, key)
        return frames | {name: mutate.delete(frames[name], keys)}, [id_]

    def _update_where(self, frames, condition, values):
        reach = {n: f for n, f in frames.items() if set(values) <= set(f.columns)}
        return frames | {n: mutate.update_where(self._full(f), self.registry, condition, values).select(*(F.col(f"`{c}`") for c in f.columns)) for n, f in reach.items()}, None

    def _delete_where(self, frames, condition):
        return {n: mutate.delete_where(self._full(f), self.registry, condition).select(*(F.col(f"`{c}`") for c in f.columns)) for n, f in frames.items()}, None

    def batch(self, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> None:
        """Apply (class, frame -> frame) in order; later steps see earlier ones. The new
        snapshot counts only if all constraints of the changed classes hold. Functions
        can't be logged, so a database with a folder refuses them."""
        if self.path:
            raise SchemaError("functions can't be logged; use transact")
        frames = dict(self.state.frames)
        for name, step in steps:
            frames[name] = step(self._frame(frames, name))
        everything = self._entities(frames)
        for name in {n for n, _ in steps}:
            mutate.validate(frames[name], self.registry, name, everything)
        self.state = self._published(self.state, plans.State(self.registry, frames, self.state.applied), [])

    def create(self, name: str | None, rows: list[dict[str, Any]]) -> None:
        self.transact([("create", name, rows)])

    def load(self, name: str, frame: DataFrame) -> None:
        """Create the entities of a frame, of any size. In a folder the log names a copy."""
        self.transact([("load", name, store.write_frame(frame, self.path)[0] if self.path else frame)])

    def replace(self, name: str | None, rows: list[dict[str, Any]]) -> None:
        self.transact([("replace", name, rows)])

    def merge(self, name: str | None, rows: list[dict[str, Any]]) -> None:
        """Overwrite what the rows give; None removes an attribute; lists grow."""
        self.transact([("merge", name, rows)])

    def patch(self, key: str, changes: dict[str, mutate.Change], expected: dict[str, Any] | None = None) -> None:
        """Change attributes of one entity. Where one of ``expected`` (attribute -> value)
        is present with another value, nothing changes and ConstraintError is raised."""
        self.transact([("patch", key, changes, expected)])

    def delete(self, key: str) -> None:
        self.transact([("delete", key)])

    def update_where(self, condition: Expr, values: dict[str, Any]) -> None:
        self.transact([("update_where", condition, values)])

    def delete_where(self, condition: Expr) -> None:
        self.transact([("delete_where", condition)])

    def _full(self, frame: DataFrame) -> DataFrame:
        """``frame`` with all attributes, absent ones null, so that any predicate applies."""
        more = [a for a in self.registry.attributes.values() if a.name not in frame.columns]
        return frame.withColumns({a.name: F.lit(None).cast(a.spark) for a in more}) if more else frame

    def purge(self) -> None:
        """Forget everything; a folder keeps its commits until it is deleted."""
        self.state, self.places = plans.State(), {}
