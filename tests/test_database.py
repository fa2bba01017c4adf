"""The client's view: writes, constraints, migrations and the log."""

import datetime
import itertools
import uuid
from dataclasses import dataclass
from typing import Annotated

import pytest
from pyspark.sql import functions as F

from lodestore.database import Database, NotFound
from lodestore.functions.values import coerce, coerce_column, from_millis, millis, natural_key, now
from lodestore.operators import mutate
from lodestore.operators.expressions import Lowering, attr, between, contains, eq, gt, gte, ident, if_, in_, is_null, list_of, literal, lt, lte, neq, regex, starts_with
from lodestore.operators.select import Select, expand, items
from lodestore.plans.migrate import declared, unify
from lodestore.schema import COUNT, ID, Attribute, EntityClass, Registry, SchemaError
from lodestore.sources import log
from lodestore.sources.store import ConflictError
from lodestore.streaming.tail import follow


def database(spark):
    db = Database(spark)
    db.migrate("first", [
        ("create_attribute", Attribute("test/text", "string")), ("create_attribute", Attribute("test/int", "int")), ("create_attribute", Attribute("test/list", "list<int>")),
        ("create_attribute", Attribute("test/key", "string", unique=True, index=True)), ("create_class", EntityClass("test/File", {"test/text": False, "test/int": False, "test/list": True, "test/key": False})),
        ("create_class", EntityClass("test/Image", {}, ("test/File",))), ("create_attribute", Attribute("test/of", "ref", classes=("test/Image",))),
        ("create_class", EntityClass("test/Note", {"test/of": False, "core/ident": False})),
    ])
    return db


def test_round_trip(spark):
    db, a = database(spark), str(uuid.uuid4())
    db.create("test/File", [{ID: a, "test/text": "x", "test/int": "5"}])
    assert db.entity(a) == {ID: a, "core/type": "test/File", "test/text": "x", "test/int": 5, "test/list": []}
    db.merge("test/File", [{ID: a, "test/list": [22, 23], "test/text": "y"}])
    db.merge("test/File", [{ID: a, "test/list": [23, 24]}])
    assert db.entity(a)["test/list"] == [22, 23, 24] and db.entity(a)["test/text"] == "y"
    db.patch(a, {"test/list": mutate.add(9), "test/text": mutate.remove()})
    assert db.entity(a)["test/list"] == [22, 23, 24, 9] and "test/text" not in db.entity(a)
    with pytest.raises(mutate.ConstraintError):
        db.create("test/File", [{ID: a}])
    db.update_where(gt(attr("test/int"), 4), {"test/int": 7})
    assert db.entity(a)["test/int"] == 7
    db.delete(a)
    with pytest.raises(NotFound):
        db.entity(a)


def test_constraints(spark):
    db, a, b = database(spark), str(uuid.uuid4()), str(uuid.uuid4())
    db.create("test/File", [{ID: a, "test/key": "k"}])
    with pytest.raises(mutate.ConstraintError):
        db.create("test/File", [{ID: b, "test/key": "k"}])
    with pytest.raises(NotFound):
        db.entity(b)  # the batch left nothing
    for target in (a, str(uuid.uuid4())):  # of another class, and of none
        with pytest.raises(mutate.ConstraintError):
            db.create("test/Note", [{"test/of": target}])
    db.create("test/Image", [{ID: b}])
    db.create("test/Note", [{"test/of": b, "core/ident": "note"}])
    assert db.entity("note")["test/of"] == b
    with pytest.raises(SchemaError):
        db.create("test/File", [{"test/int": "hello"}])
    with pytest.raises(SchemaError):
        db.create("test/File", [{"core/title": "not of the class"}])


def test_counts(spark):
    db = database(spark)
    assert db.select(Select(count=True)).first()[0] == 0
    db.create("test/File", [{"test/int": k} for k in range(-10, 11)])
    i = attr("test/int")
    for where, n in ((eq(i, 5), 1), (gt(i, 0), 10), (gte(i, 0), 11), (lt(i, 0), 10), (lte(i, 0), 11), (lt(i, 0.5), 11), (in_(i, [1, 2, None]), 2), (lt(i, "a"), 21)):
        assert db.select(Select(where, count=True)).first()[COUNT] == n
    assert db.select(Select(limit=3, offset=20, count=True)).first()[0] == 1
    db.delete_where(lt(i, 6))
    assert db.select(Select(count=True)).first()[0] == 5


VALUES = {"test/i": [None, -3, 0, 4], "test/f": [None, -3.0, 0.5, float("inf")], "test/s": [None, "", "a9", "a10", "A"], "test/r": [None, "0" * 8 + "-0000-0000-0000-" + "0" * 12, "f" * 8 + "-ffff-ffff-ffff-" + "f" * 12]}
RANK = {"test/i": 3, "test/f": 3, "test/s": 4, "test/r": 0}
NATURAL = {"": 0, "A": 1, "a9": 2, "a10": 3}


def test_truth_table(spark):
    """Every comparison of attributes of every kind against the order of values."""
    registry = Registry()
    for name, kind in (("test/i", "int"), ("test/f", "float"), ("test/s", "string"), ("test/r", "ref")):
        registry = registry.with_attribute(Attribute(name, kind))
    rows = list(itertools.product(*VALUES.values()))
    frame = spark.createDataFrame(rows, "`test/i` long, `test/f` double, `test/s` string, `test/r` string").coalesce(1).cache()
    lower = Lowering(registry)

    def order(name, v):
        return (1, 0) if v is None else (RANK[name], NATURAL[v] if name == "test/s" else v)

    def check(make, test, a, b):
        got = [r[0] for r in frame.select(lower.predicate(make(attr(a), attr(b)))).collect()]
        at = list(VALUES)
        assert got == [test(order(a, r[at.index(a)]), order(b, r[at.index(b)])) for r in rows], (make.__name__, a, b)

    for a, b in itertools.product(VALUES, VALUES):
        check(eq, lambda x, y: x == y, a, b)
        check(neq, lambda x, y: x != y, a, b)
        check(lt, lambda x, y: x < y, a, b)
        check(gte, lambda x, y: x >= y, a, b)
        check(lte, lambda x, y: x <= y, a, b)
        check(gt, lambda x, y: x > y, a, b)


def test_expressions(spark):
    db = database(spark)
    db.create("test/File", [{"test/text": t, "test/list": v} for t, v in (("alpha 1", [22, 23]), ("ALPHA 223", [1]), ("alpha", []), (None, None))])
    text, items = attr("test/text"), attr("test/list")
    for where, n in ((regex(text, r"alpha \d+"), 1), (regex(text, r"alpha \d+", True), 2), (contains(text, "pha"), 2), (contains(items, [22, 5]), 1), (in_(1, items), 1), (~contains(text, "%"), 4), (is_null(text), 1), (if_(is_null(text), literal(True), literal(False)), 1), (~text, 4)):
        assert db.select(Select(where, count=True)).first()[0] == n
    with pytest.raises(SchemaError):
        db.select(Select(regex(text, "a(?=b)")))
    with pytest.raises(SchemaError):
        db.select(Select(eq(attr("test/none"), 1)))


def test_idents_lists_and_prefixes(spark):
    db, a = database(spark), str(uuid.uuid4())
    db.create("test/Image", [{ID: a, "test/text": "alpha", "test/int": 3}, {"test/text": "beta"}])
    db.create("test/Note", [{"test/of": a, "core/ident": "note"}])
    db.migrate("names", [("add_attribute", "test/File", "core/ident", False)])
    db.merge("test/Image", [{ID: a, "core/ident": "picture"}])
    text, i, of = attr("test/text"), attr("test/int"), attr("test/of")
    for where, n in (
        (eq(of, ident("picture")), 1), (~eq(of, ident("picture")), 2), (in_(of, list_of(ident("picture"), ident("note"))), 1), (starts_with(text, "al"), 1), (~starts_with(text, "al"), 2),
        (starts_with(i, "a"), 0), (between(i, 3, 4), 1), (between(i, 4, 5), 0), (in_(i, list_of(3, 4)), 1), (in_(i, list_of()), 0), (in_(i, list_of(None)), 2), (in_(text, list_of(text)), 3),
    ):
        assert db.select(Select(where, count=True)).first()[0] == n, where
    with pytest.raises(SchemaError):
        db.select(Select(eq(of, ident("nothing"))))


def test_expected_values(spark):
    db, a = database(spark), str(uuid.uuid4())
    db.create("test/File", [{ID: a, "test/text": "x"}])
    before = db.state
    with pytest.raises(mutate.ConstraintError):
        db.patch(a, {"test/text": mutate.put("z")}, {"test/text": "y"})
    assert db.state is before
    db.patch(a, {"test/text": mutate.put("z"), "test/int": mutate.put(1)}, {"test/text": "x", "test/int": 5})  # absent values may be set
    assert db.entity(a)["test/text"] == "z" and db.entity(a)["test/int"] == 1
    db.patch(a, {"test/text": mutate.remove_if("other"), "test/int": mutate.remove_if(1)})
    assert db.entity(a)["test/text"] == "z" and "test/int" not in db.entity(a)


@dataclass
class Thing:
    label: str
    tags: list[str]
    owner: uuid.UUID | None = None


@dataclass
class Tool(Thing):
    weight: float | None = None


@dataclass
class Odd:
    what: complex


def test_declared_classes(spark):
    db = Database(spark)
    db.migrate("things", declared(Thing, "kit") + declared(Tool, "kit"))
    assert db.registry.members("kit/Tool") == {"kit/label": True, "kit/tags": True, "kit/owner": False, "kit/weight": False}
    db.create("kit/Tool", [{"kit/label": "saw", "kit/weight": 2, "core/id": str(uuid.UUID(int=1))}])
    assert db.entity(str(uuid.UUID(int=1))) == {ID: str(uuid.UUID(int=1)), "core/type": "kit/Tool", "kit/label": "saw", "kit/tags": [], "kit/weight": 2.0}
    with pytest.raises(mutate.ConstraintError):
        db.create("kit/Thing", [{"kit/tags": ["a"]}])
    with pytest.raises(SchemaError):
        declared(Odd, "kit")


@dataclass
class Marked:
    code: Annotated[str, {"unique": True, "title": "Code"}]
    note: Annotated[str | None, {"name": "kit/remark"}]


def test_declared_attributes():
    (_, code), (_, note), (_, marked) = declared(Marked, "kit")
    assert code == Attribute("kit/code", "string", unique=True, title="Code") and note == Attribute("kit/remark", "string")
    assert marked.attributes == {"kit/code": True, "kit/remark": False}


def test_unified_migrations(spark):
    first = [("create_attribute", Attribute("t/a", "int")), ("create_attribute", Attribute("t/b", "string")), ("create_class", EntityClass("t/Base", {"t/a": False})), ("create_class", EntityClass("t/More", {"t/b": True}, ("t/Base",)))]
    second = [("create_attribute", Attribute("t/of", "ref", classes=("t/More",))), ("add_attribute", "t/More", "t/of", False), ("create_index", "t/b", True), ("change_type", "t/a", Attribute("t/a", "list<int>"))]
    third = [("create_attribute", Attribute("t/c", "int")), ("create_class", EntityClass("t/Gone", {"t/c": False})), ("delete_class", "t/Gone"), ("delete_attribute", "t/c")]
    steps, whole = Database(spark), Database(spark)
    for name, actions in zip("xyz", (first, second, third), strict=True):
        steps.migrate(name, actions)
    whole.migrate(*unify(list(zip("xyz", (first, second, third), strict=True)), "all"))
    assert whole.registry.attributes == steps.registry.attributes and whole.registry.classes == steps.registry.classes
    assert whole.migrations() == ("all",)
    with pytest.raises(SchemaError):
        unify([("x", first), ("x", second)], "all")
    assert unify([], "none") == ("none", [])


def test_moments(spark):
    numbers = [0, 1, 1_700_000_000_123, 2**41, None, -5]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        rows = spark.createDataFrame([(n,) for n in numbers], "n long").select(from_millis(F.col("n")).alias("m"), millis(from_millis(F.col("n"))).alias("n"), (millis(now()) > 1_700_000_000_000).alias("late")).collect()
        assert [r["n"] for r in rows] == numbers and all(r["late"] for r in rows)
        assert rows[2]["m"] == datetime.datetime(2023, 11, 14, 22, 13, 20, 123000)
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_items(spark):
    left = spark.createDataFrame([("1", "9"), ("2", None)], f"`{ID}` string, `t/of` string")
    right = spark.createDataFrame([("9", None, 4)], f"`{ID}` string, `t/x` string, `t/y` long")
    one, two = sorted(items(expand(left, right, "t/of", "of"), "of"), key=lambda i: i.data[ID])
    assert one.flat() == [{ID: "1", "t/of": "9"}, {ID: "9", "t/y": 4}] and two.flat() == [{ID: "2"}]


def test_natural_order(spark):
    names = ["a10", "a9", "a010b", "a10a", "b", "", "a", "9", "10", "a" + "9" * 50, "a1" + "0" * 50]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").orderBy(natural_key(F.col("s"))).collect()]
    assert got[:4] == ["", "9", "10", "a"] and got.index("a9") < got.index("a10") < got.index("a10a") and got[-3:] == ["a" + "9" * 50, "a1" + "0" * 50, "b"]


def test_migrations(spark):
    db = database(spark)
    db.create("test/File", [{"test/int": 1}])
    db.migrate("second", [("create_attribute", Attribute("test/grade", "int")), ("add_attribute", "test/File", "test/grade", True, 42), ("change_type", "test/int", Attribute("test/int", "list<int>"))])
    row = db.frame("test/File").first()
    assert row["test/grade"] == 42 and row["test/int"] == [1]
    before = db.state
    for actions in ([("add_attribute", "test/File", "test/text", True, None)], [("delete_attribute", "test/grade")], [("delete_class", "test/File")], [("change_type", "test/text", Attribute("test/text", "int"))]):
        with pytest.raises(SchemaError):
            db.migrate("bad", actions)
    assert db.state is before
    with pytest.raises(SchemaError):
        db.migrate("second", [])
    db.migrate("third", [("remove_attribute", "test/File", "test/grade", True), ("make_optional", "test/File", "test/list"), ("delete_attribute", "test/grade"), ("upsert_attribute", Attribute("test/text", "string")), ("delete_class", "test/Note")])
    assert "test/grade" not in db.frame("test/File").columns
    assert Registry.from_json(db.registry.to_json()).to_json() == db.registry.to_json()
    db.migrate("unions", [("create_attribute", Attribute("test/u", "string", allowed=("a", "b")))])
    with pytest.raises(SchemaError):
        coerce("c", db.registry.attribute("test/u"))
    db.migrate("more", [("change_type", "test/u", Attribute("test/u", "string", allowed=("a", "b", "c")))])
    assert coerce("c", db.registry.attribute("test/u")) == "c"


def test_coercion(spark):
    of = lambda kind, v: coerce(v, Attribute("a/b", kind))
    assert (of("int", 3.0), of("int", "7"), of("float", 2**63 - 1), of("string", 5), of("list<int>", 4), of("bytes", [1, 2])) == (3, 7, float(2**63 - 1), "5", [4], b"\x01\x02")
    assert of("datetime", "2024-01-01T00:00:01.9Z") == datetime.datetime(2024, 1, 1, 0, 0, 1)
    for kind, v in (("int", 1.5), ("int", True), ("int", 2**63), ("uint", -1), ("bool", 1), ("string", True), ("ref", "x"), ("url", "x"), ("int", [22])):
        with pytest.raises(SchemaError):
            of(kind, v)
    texts = spark.createDataFrame([("12",), ("1.5",), ("x",), (None,), ("99999999999999999999",)], "s string")
    assert [r[0] for r in texts.select(coerce_column(F.col("s"), "int")).collect()] == [12, None, None, None, None]


def test_log(spark, tmp_path):
    ops = [(1, "create", "a", '{"x": 1, "y": "p"}'), (2, "merge", "a", '{"x": 2}'), (3, "create", "b", '{"x": 5}'), (4, "delete", "b", None), (5, "replace", "a", '{"y": "q"}'), (6, "merge", "c", '{"x": 9}')]
    path = str(tmp_path / "log")
    for op in ops:
        log.append(spark.createDataFrame([op], log.EVENT), path)
    got = log.replay(log.parsed(log.read(spark, path), "x long, y string"), ["x", "y"])
    assert sorted(map(tuple, got.collect())) == [("a", None, "q"), ("c", 9, None)]
    early = log.replay(log.parsed(log.read(spark, path, last=3), "x long, y string"), ["x", "y"])
    assert sorted(map(tuple, early.collect())) == [("a", 2, "p"), ("b", 5, None)]
    seen = []
    for _ in range(2):
        follow(spark, path, lambda df, n: seen.extend(r["seq"] for r in df.collect()), str(tmp_path / "at"), once=True).awaitTermination()
    assert sorted(seen) == [1, 2, 3, 4, 5, 6]


A, B, C = (f"0000000{k}-0000-0000-0000-000000000000" for k in (1, 2, 3))


def test_one_id_one_entity(spark):
    """Over all classes, and within one call."""
    db = database(spark)
    db.create("test/File", [{ID: A, "test/text": "x", "test/int": 1}])
    with pytest.raises(mutate.ConstraintError):
        db.create("test/Note", [{ID: A}])
    with pytest.raises(mutate.ConstraintError):
        db.create("test/File", [{ID: B}, {ID: B}])
    with pytest.raises(mutate.ConstraintError):
        db.merge("test/Note", [{ID: A, "core/ident": "n"}])
    db.merge("test/File", [{ID: A, "test/int": 2, "test/list": [1]}, {ID: A, "test/text": None, "test/list": [2, 1]}])
    assert db.entity(A) == {ID: A, "core/type": "test/File", "test/int": 2, "test/list": [1, 2]}
    db.replace("test/Note", [{ID: A, "core/ident": "m"}, {ID: A, "core/ident": "n"}])
    assert db.entity(A) == {ID: A, "core/type": "test/Note", "core/ident": "n"}
    assert db.select(Select(count=True)).first()[0] == 1
    with pytest.raises(mutate.ConstraintError):
        db.transact([("create", "test/File", [{ID: B}]), ("create", "test/File", [{ID: B}])])
    assert db.select(Select(count=True)).first()[0] == 1


def test_attribute_without_frame(spark):
    db = database(spark)
    db.create("test/File", [{ID: A}])
    assert db.select(Select(is_null(attr("test/of")), count=True)).first()[0] == 1
    assert db.select(Select(eq(attr("core/title"), "x"), count=True)).first()[0] == 0
    assert len(db.page(Select(), 0, 10)) == 1 and db.page(Select(), 1, 10) == []


def test_entities_without_class(spark):
    db = database(spark)
    db.create(None, [{ID: A, "test/int": 3}, {ID: B, "test/text": "t", "core/ident": "plain"}])
    db.create(None, [{ID: C, "test/list": [1]}])
    assert db.entity("plain") == {ID: B, "test/text": "t", "core/ident": "plain"}
    assert db.select(Select(gte(attr("test/int"), 3), count=True)).first()[0] == 1
    db.merge(None, [{ID: A, "test/key": "k"}])
    db.patch(A, {"test/int": mutate.put(4)})
    with pytest.raises(mutate.ConstraintError):
        db.create("test/File", [{"test/key": "k"}])
    with pytest.raises(SchemaError):
        db.create(None, [{"test/none": 1}])
    assert db.entity(A) == {ID: A, "test/int": 4, "test/key": "k"}
    db.delete(A)
    assert db.select(Select(count=True)).first()[0] == 2


def test_durable(spark, tmp_path):
    path = str(tmp_path / "db")
    db = Database.open(spark, path)
    assert db.version == 0
    first = database(spark)
    db.transact([("migrate", "first", [("create_attribute", a) for a in first.registry.attributes.values() if a.name.startswith("test/") and a.name != "test/of"])])
    db.migrate("second", [("create_class", EntityClass("test/File", {"test/text": False, "test/int": False, "test/list": True, "test/key": False}))])
    db.create("test/File", [{ID: A, "test/int": 1}, {"test/text": "fresh"}])
    db.patch(A, {"test/list": mutate.add(5), "test/text": mutate.put("p")}, {"test/int": 1})
    db.update_where(gt(attr("test/int"), 0), {"test/int": 9})
    db.create(None, [{ID: B, "test/text": "loose"}])
    other = Database.open(spark, path)
    assert other.entity(A) == db.entity(A) == {ID: A, "core/type": "test/File", "test/int": 9, "test/list": [5], "test/text": "p"}
    assert other.migrations() == ("first", "second") and other.version == db.version == 6
    with pytest.raises(SchemaError):
        db.create("test/File", [{"test/int": "bad"}])
    with pytest.raises(mutate.ConstraintError):
        db.patch(A, {"test/int": mutate.put(0)}, {"test/int": 1})
    assert Database.open(spark, path).version == 6  # nothing of a refused commit is left
    with pytest.raises(NotFound):
        Database.open(spark, path, 2).entity(A)
    again = Database.rebuild(spark, path, str(tmp_path / "copy"))
    rows = lambda d: sorted(map(str, map(sorted, (r.asDict().items() for r in d.select(Select()).collect()))))
    assert {r["test/text"] for r in again.select(Select()).collect()} == {"p", "fresh", "loose"}
    assert rows(again) == rows(db) == rows(Database.open(spark, str(tmp_path / "copy")))
    assert [r["op"] for r in db.events().orderBy("version", "number").collect()] == ["migrate", "migrate", "create", "patch", "update_where", "create"]
    other.delete(B)
    with pytest.raises(ConflictError):
        db.delete(B)


def test_plans_stay_flat(spark, tmp_path):
    db = Database.open(spark, str(tmp_path / "db"))
    db.migrate("m", [("create_attribute", Attribute("test/int", "int"))])
    sizes = []
    for k in range(4):
        db.merge(None, [{ID: A, "test/int": k}])
        sizes.append(db.frame("")._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert len(set(sizes)) == 1 and db.entity(A)["test/int"] == 3


def test_coerced_columns(spark):
    frame = spark.createDataFrame([("true",), ("yes",), ("a/b",), (None,)], "v string")
    got = frame.select(*(coerce_column(F.col("v"), k).alias(k) for k in ("bool", "ident", "bytes"))).collect()
    assert [r["bool"] for r in got] == [True, None, None, None]
    assert [r["ident"] for r in got] == [None, None, "a/b", None]
    assert [r["bytes"] for r in got] == [b"true", b"yes", b"a/b", None]
