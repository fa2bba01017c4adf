"""Registered queries of the entity operators, with their DuckDB SQL.

Each query reads whole tables as class frames. ``party`` is customers and suppliers, the
two classes under tpch/Party, which lack each other's attributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database
from .functions.values import coerce_column, entity_id, from_millis, millis
from .operators import mutate
from .operators.expressions import attr, between, contains, eq, gt, gte, ident, if_, in_, inherits, is_class, is_not_null, is_null, list_of, lt, lte, neq, regex, starts_with
from .operators.select import Select, by_id, entities, expand, run
from .plans import migrate as plans
from .schema import COUNT, ID, IDENT, TYPE, Attribute
from .sources import log, store
from .sources.tables import MAPPING, actions_of, class_frame, registry_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _id(table: str, key: str) -> str:
    return rf"regexp_replace(md5('{table}|' || {key}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\1-\2-\3-\4-\5')"


_PARTY = f"""(SELECT {_id('customer', 'c_custkey')} AS id, 'tpch/Customer' AS class, 'customer-' || c_custkey AS ident,
    c_name, c_acctbal, c_mktsegment, c_nationkey, {_id('nation', 'c_nationkey')} AS c_ref, NULL::VARCHAR AS s_name, NULL::DOUBLE AS s_acctbal FROM customer
  UNION ALL SELECT {_id('supplier', 's_suppkey')}, 'tpch/Supplier', 'supplier-' || s_suppkey, NULL, NULL, NULL, NULL, NULL, s_name, s_acctbal FROM supplier)"""


def register(name: str, sql: str | None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return keep


def _frames(spark: SparkSession, sf_dir: str, *tables: str) -> tuple[dict[str, DataFrame], object]:
    frames = {t: class_frame(spark, sf_dir, t) for t in tables}
    return frames, registry_of(frames)


_SHOWN = {"id": ID, "class": TYPE, "ident": IDENT}


def _show(df: DataFrame, **columns: str) -> DataFrame:
    return df.select(*(F.col(f"`{v}`").alias(k) for k, v in (_SHOWN | columns).items()))


def _party(where, sql: str, name: str, order=(), **more) -> None:
    """A selection over customers and suppliers."""
    tail = more.pop("tail", "")

    @register(name, f"SELECT id, class, ident FROM {_PARTY} WHERE {sql} {tail}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames, registry = _frames(spark, sf_dir, "customer", "supplier")
        return _show(run(entities(frames), registry, Select(where, list(order), **more)))


_BALANCE, _NAME, _SEGMENT, _REF, _OTHER = attr("tpch/c_acctbal"), attr("tpch/c_name"), attr("tpch/c_mktsegment"), attr("tpch/c_nationkey_ref"), attr("tpch/s_acctbal")
_UUID = "80000000-0000-0000-0000-000000000000"

_party(is_class("tpch/Supplier"), "class = 'tpch/Supplier'", "type_eq")
_party(inherits("tpch/Party"), "true", "inherits_type")
_party(eq(attr(IDENT), "customer-7"), "ident = 'customer-7'", "ident_lookup")
_party(eq(_SEGMENT, "BUILDING"), "c_mktsegment = 'BUILDING'", "filter_eq")
_party(neq(_SEGMENT, "BUILDING"), "c_mktsegment IS DISTINCT FROM 'BUILDING'", "neq_absent")
_party(lt(_BALANCE, 0), "c_acctbal IS NULL OR c_acctbal < 0", "lt_absent")
_party(lte(_BALANCE, 100.5), "c_acctbal IS NULL OR c_acctbal <= 100.5", "lte_absent")
_party(gt(_BALANCE, 5000), "c_acctbal > 5000", "gt_present")
_party(gte(_OTHER, _BALANCE), "s_acctbal >= c_acctbal OR c_acctbal IS NULL", "gte_attributes")
_party(lt(_REF, _UUID), f"c_ref < '{_UUID}'", "ref_lt")
_party(gt(_REF, _UUID), f"c_ref IS NULL OR c_ref > '{_UUID}'", "ref_gt_absent")
_party((gt(_BALANCE, 0) & eq(_SEGMENT, "MACHINERY")) | ~lt(_OTHER, 9000), "coalesce(c_acctbal > 0 AND c_mktsegment = 'MACHINERY', false) OR s_acctbal >= 9000", "and_or_not")
_party(~_BALANCE, "true", "not_of_number")
_party(in_(_SEGMENT, ["BUILDING", "FURNITURE"]), "c_mktsegment IN ('BUILDING', 'FURNITURE')", "in_list")
_party(~in_(_SEGMENT, ["BUILDING", None]), "NOT (c_mktsegment IS NULL OR c_mktsegment = 'BUILDING')", "not_in_list")
_party(in_(_SEGMENT, list_of(_NAME, "BUILDING")), "c_mktsegment IS NOT DISTINCT FROM c_name OR c_mktsegment = 'BUILDING'", "in_expressions")
_party(between(_BALANCE, 100, 2000), "c_acctbal BETWEEN 100 AND 2000", "range_scan")
_party(starts_with(_SEGMENT, "MA"), "starts_with(c_mktsegment, 'MA')", "prefix_scan")
_party(contains(_NAME, "#00000000"), "contains(c_name, '#00000000')", "contains_text")
_party(regex(_NAME, r"0+1\d$"), r"regexp_matches(c_name, '0+1\d$')", "regex_match")
_party(regex(_SEGMENT, "^mach", True), "regexp_matches(c_mktsegment, '^mach', 'i')", "regex_any_case")
_party(if_(is_class("tpch/Supplier"), gt(_OTHER, 5000), lt(_BALANCE, 1000)), "CASE WHEN class = 'tpch/Supplier' THEN s_acctbal > 5000 ELSE c_acctbal < 1000 END", "if_branches")
_party(is_null(_BALANCE), "c_acctbal IS NULL", "is_absent")
_party(is_not_null(_OTHER), "s_acctbal IS NOT NULL", "is_present")
_party(lt(_BALANCE, "x") & ~gt(_BALANCE, "x"), "true", "kinds_differ")
_party(gte(attr(IDENT), "supplier-3") & lt(attr(IDENT), "supplier-12"), "class = 'tpch/Supplier' AND split_part(ident, '-', 2)::INT BETWEEN 3 AND 11", "natural_range")
_party(is_not_null(_NAME), "c_name IS NOT NULL", "sort_limit_offset", [("tpch/c_acctbal", True)], offset=5, limit=40, tail="ORDER BY c_acctbal DESC NULLS LAST, id LIMIT 40 OFFSET 5")
_party(None, "true", "sort_several", [("tpch/c_mktsegment", False), ("tpch/s_acctbal", True)], limit=250, tail="ORDER BY c_mktsegment ASC NULLS FIRST, s_acctbal DESC NULLS LAST, id LIMIT 250")
_party(None, "true", "sort_natural", [(IDENT, False)], limit=120, tail="ORDER BY split_part(ident, '-', 1), split_part(ident, '-', 2)::INT LIMIT 120")
_party(None, "true", "sort_reference", [("tpch/c_nationkey_ref", False)], limit=90, tail="ORDER BY c_ref ASC NULLS LAST, id LIMIT 90")


@register("id_lookup", f"SELECT id, class, ident FROM {_PARTY} WHERE id = {_id('supplier', '3')}")
def id_lookup(spark, sf_dir):
    frames, _ = _frames(spark, sf_dir, "customer", "supplier")
    key = spark.range(1).select(entity_id(F.lit("supplier"), F.lit(3))).first()[0]
    return _show(by_id(entities(frames), key))


@register("ident_reference", f"SELECT {_id('customer', 'c_custkey')} AS id FROM customer WHERE c_nationkey = 7")
def ident_reference(spark, sf_dir):
    """Customers of the nation that an ident names."""
    frames, registry = _frames(spark, sf_dir, "customer", "nation")
    return run(entities(frames), registry, Select(eq(_REF, ident("nation-7")))).select(F.col(f"`{ID}`").alias("id"))


def _count(name: str, where, sql: str, **more) -> None:
    @register(name, sql)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames, registry = _frames(spark, sf_dir, "customer", "supplier", "nation", "orders")
        return run(entities(frames), registry, Select(where, count=True, **more)).select(F.col(f"`{COUNT}`").alias("n"))


_ALL = "((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM orders))::BIGINT"
_count("count_all", None, f"SELECT {_ALL} AS n")
_count("count_filtered", lt(attr("tpch/o_totalprice"), 1000), f"SELECT ({_ALL} - (SELECT count(*) FROM orders WHERE o_totalprice >= 1000))::BIGINT AS n")
_count("count_after_limit", inherits("tpch/Party"), f"SELECT least(50, greatest(0, (SELECT count(*) FROM {_PARTY}) - 10))::BIGINT AS n", offset=10, limit=50)


@register("list_member", "SELECT vec_id, label FROM embeddings WHERE list_contains(embedding::DOUBLE[], embedding[1]::DOUBLE) AND NOT list_contains(embedding::DOUBLE[], 2.0)")
def list_member(spark, sf_dir):
    frames, registry = _frames(spark, sf_dir, "embeddings")
    found = run(entities(frames), registry, Select(~in_(2.0, attr("doc/embedding")) & contains(attr("doc/embedding"), attr("doc/embedding"))))
    return found.select(F.col("`doc/vec_id`").alias("vec_id"), F.col("`doc/label`").cast("int").alias("label"))


@register("list_words", "SELECT doc_id FROM documents WHERE list_has_any(string_split(text, ' '), ['The', 'by']) AND NOT list_contains(string_split(text, ' '), 'from')")
def list_words(spark, sf_dir):
    """Documents whose list of words has one of two, but not a third."""
    frames, registry = _frames(spark, sf_dir, "documents")
    frames["documents"] = frames["documents"].withColumn("doc/words", F.split("`doc/text`", " "))
    found = run(entities(frames), registry.with_attribute(Attribute("doc/words", "list<string>")), Select(contains(attr("doc/words"), ["The", "by"]) & ~in_("from", attr("doc/words"))))
    return found.select(F.col("`doc/doc_id`").alias("doc_id"))


@register("expand_reference", f"SELECT {_id('customer', 'c_custkey')} AS id, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def expand_reference(spark, sf_dir):
    frames, _ = _frames(spark, sf_dir, "customer", "nation")
    return expand(frames["customer"], frames["nation"], "tpch/c_nationkey_ref", "nation").select(F.col(f"`{ID}`").alias("id"), F.col("nation.`tpch/n_name`").alias("n_name"))


def _customers(df: DataFrame) -> DataFrame:
    return _show(df, balance="tpch/c_acctbal", segment="tpch/c_mktsegment").drop("class", "ident")


_C = _id("customer", "c_custkey")


LARGE = 450_000


def _delta(spark, sf_dir) -> DataFrame:
    """A change per customer with a large order: the largest price as balance."""
    orders = class_frame(spark, sf_dir, "orders").groupBy("`tpch/o_custkey_ref`").agg(F.max("`tpch/o_totalprice`").alias("tpch/c_acctbal"))
    orders = orders.where(F.col("`tpch/c_acctbal`") > LARGE)
    return orders.withColumnRenamed("tpch/o_custkey_ref", ID).where(F.col(f"`{ID}`").isNotNull())


_D = f"(SELECT o_custkey AS k, max(o_totalprice) AS b FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING max(o_totalprice) > {LARGE})"


@register("mutate_merge", f"SELECT {_id('customer', 'coalesce(c_custkey, k)')} AS id, coalesce(b, c_acctbal) AS balance, c_mktsegment AS segment FROM customer FULL JOIN {_D} ON k = c_custkey")
def mutate_merge(spark, sf_dir):
    return _customers(mutate.merge(class_frame(spark, sf_dir, "customer"), _delta(spark, sf_dir)))


@register("mutate_replace", f"SELECT {_C} AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_custkey NOT IN (SELECT k FROM {_D}) UNION ALL SELECT {_id('customer', 'k')}, b, NULL FROM {_D}")
def mutate_replace(spark, sf_dir):
    return _customers(mutate.replace(class_frame(spark, sf_dir, "customer"), _delta(spark, sf_dir)))


@register("mutate_create", f"SELECT {_C} AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT {_id('supplier', 's_suppkey')}, s_acctbal, NULL FROM supplier")
def mutate_create(spark, sf_dir):
    new = class_frame(spark, sf_dir, "supplier").select(F.col(f"`{ID}`"), F.col("`tpch/s_acctbal`").alias("tpch/c_acctbal"))
    return _customers(mutate.create(class_frame(spark, sf_dir, "customer"), new))


@register("mutate_delete", f"SELECT {_C} AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_custkey NOT IN (SELECT k FROM {_D})")
def mutate_delete(spark, sf_dir):
    return _customers(mutate.delete(class_frame(spark, sf_dir, "customer"), _delta(spark, sf_dir)))


@register("update_where", f"SELECT {_C} AS id, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS balance, c_mktsegment AS segment FROM customer")
def update_where(spark, sf_dir):
    frames, registry = _frames(spark, sf_dir, "customer")
    return _customers(mutate.update_where(frames["customer"], registry, lt(_BALANCE, 0), {"tpch/c_acctbal": 0}))


@register("delete_where", f"SELECT {_C} AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING')")
def delete_where(spark, sf_dir):
    frames, registry = _frames(spark, sf_dir, "customer")
    return _customers(mutate.delete_where(frames["customer"], registry, lt(_BALANCE, 0) | eq(_SEGMENT, "BUILDING")))


@register("patch_values", f"SELECT {_C} AS id, NULL::DOUBLE AS balance, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSE' ELSE c_mktsegment END AS segment FROM customer")
def patch_values(spark, sf_dir):
    return _customers(mutate.patch(class_frame(spark, sf_dir, "customer"), {"tpch/c_acctbal": mutate.remove(), "tpch/c_mktsegment": mutate.put_if("BUILDING", "HOUSE")}))


@register("patch_lists", "SELECT vec_id, list_filter(embedding::DOUBLE[], lambda x: x <> 2.0) || [1.5::DOUBLE] AS v FROM embeddings")
def patch_lists(spark, sf_dir):
    frame = class_frame(spark, sf_dir, "embeddings")
    patched = mutate.patch(mutate.patch(frame, {"doc/embedding": mutate.add(1.5)}), {"doc/embedding": mutate.remove_value(2.0)})
    return patched.select(F.col("`doc/vec_id`").alias("vec_id"), F.col("`doc/embedding`").alias("v"))


def _lines(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`tpch/{c}`").alias(c) for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_tax")))


_L = "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity"


@register("update_lines", f"{_L}, CASE WHEN l_discount > 0.05 AND l_returnflag = 'R' THEN 0 ELSE l_tax END AS l_tax FROM lineitem")
def update_lines(spark, sf_dir):
    frames, registry = _frames(spark, sf_dir, "lineitem")
    return _lines(mutate.update_where(frames["lineitem"], registry, gt(attr("tpch/l_discount"), 0.05) & eq(attr("tpch/l_returnflag"), "R"), {"tpch/l_tax": 0}))


@register("delete_lines", f"{_L}, l_tax FROM lineitem WHERE NOT (l_quantity >= 30 AND l_linestatus = 'O')")
def delete_lines(spark, sf_dir):
    frames, registry = _frames(spark, sf_dir, "lineitem")
    return _lines(mutate.delete_where(frames["lineitem"], registry, gte(attr("tpch/l_quantity"), 30) & eq(attr("tpch/l_linestatus"), "O")))


@register("document_patterns", "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}') OR (contains(text, 'http') AND lang = 'en')")
def document_patterns(spark, sf_dir):
    frames, registry = _frames(spark, sf_dir, "documents")
    text = attr("doc/text")
    found = run(entities(frames), registry, Select(regex(text, "[0-9]{3}-[0-9]{4}") | (contains(text, "http") & eq(attr("doc/lang"), "en"))))
    return found.select(F.col("`doc/doc_id`").alias("doc_id"), F.col("`doc/lang`").alias("lang"))


@register("dangling_labels", f"SELECT {_id('labels', 'doc_id')} AS id FROM labels WHERE doc_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def dangling_labels(spark, sf_dir):
    """Labels whose document's number is no order's with lines."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(entity_id(F.lit("labels"), F.col("doc_id")).alias(ID), F.col("doc_id").cast("string").alias("x/ref"))
    lines = class_frame(spark, sf_dir, "lineitem").select(F.col("`tpch/l_orderkey`").cast("string").alias(ID)).distinct()
    return mutate.dangling(labels, "x/ref", lines).select(F.col(f"`{ID}`").alias("id"))


def _loaded(spark, sf_dir, *names: str) -> tuple[str, Database]:
    """A database in a new folder with some tables, targets of references first."""
    frames, registry = _frames(spark, sf_dir, *names)
    path = store.shared_dir(spark)
    made = Database.open(spark, path)
    made.migrate("tables", actions_of(registry))
    for t in names:
        made.load(MAPPING[t][0], frames[t])
    return path, made


@register("restore_then_select", f"""SELECT {_C} AS id, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS balance, c_mktsegment AS segment FROM customer
    WHERE c_mktsegment <> 'BUILDING' AND CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END < 5000""")
def restore_then_select(spark, sf_dir):
    """Customers loaded into a database in a folder, changed in two commits, and selected
    from the database as it is opened again."""
    path, made = _loaded(spark, sf_dir, "region", "nation", "customer")
    made.update_where(lt(_BALANCE, 0), {"tpch/c_acctbal": 0})
    made.delete_where(eq(_SEGMENT, "BUILDING"))
    return _customers(Database.open(spark, path).select(Select(lt(_BALANCE, 5000) & is_not_null(_BALANCE))))


@register("rebuild_from_log", f"SELECT {_id('nation', 'n_nationkey')} AS id, CASE n_nationkey WHEN 7 THEN 'seven' WHEN 3 THEN NULL ELSE n_name END AS name, CASE WHEN n_nationkey = 3 THEN ['x'] END AS tags FROM nation WHERE n_nationkey <> 5")
def rebuild_from_log(spark, sf_dir):
    """Patches, a migration and a deletion, logged and built again from the log alone."""
    key = lambda k: f"nation-{k}"
    path, made = _loaded(spark, sf_dir, "region", "nation")
    made.migrate("tags", [("create_attribute", Attribute("tpch/tags", "list<string>")), ("add_attribute", "tpch/Nation", "tpch/tags", False)])
    made.transact([("patch", key(7), {"tpch/n_name": mutate.put("seven")}), ("patch", key(3), {"tpch/n_name": mutate.remove(), "tpch/tags": mutate.add("x")}), ("delete", key(5))])
    again = Database.rebuild(spark, path).select(Select(is_class("tpch/Nation")))
    return again.select(F.col(f"`{ID}`").alias("id"), F.col("`tpch/n_name`").alias("name"), F.col("`tpch/tags`").alias("tags"))


@register("unique_violations", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return mutate.repeated(class_frame(spark, sf_dir, "part"), "tpch/p_name")


@register("dangling_references", f"SELECT {_id('orders', 'o_orderkey')} AS id FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def dangling_references(spark, sf_dir):
    """Orders whose customer number isn't a supplier's: references into another table."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(entity_id(F.lit("orders"), F.col("o_orderkey")).alias(ID), entity_id(F.lit("supplier"), F.col("o_custkey")).alias("x/ref"))
    return mutate.dangling(orders, "x/ref", class_frame(spark, sf_dir, "supplier")).select(F.col(f"`{ID}`").alias("id"))


@register("wrong_class_references", f"SELECT {_C} AS id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def wrong_class_references(spark, sf_dir):
    frames, _ = _frames(spark, sf_dir, "customer", "nation")
    return mutate.wrong_class(frames["customer"], "tpch/c_nationkey_ref", entities(frames), ["tpch/Region"]).select(F.col(f"`{ID}`").alias("id"))


@register("wrong_class_mixed", f"SELECT {_C} AS id FROM customer JOIN region ON c_nationkey = r_regionkey WHERE c_acctbal < 0")
def wrong_class_mixed(spark, sf_dir):
    """Customers that refer to a region in place of a nation, as those in debt do here."""
    frames, _ = _frames(spark, sf_dir, "region", "nation")
    rows, key = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_nationkey")
    target = F.when(F.col("c_acctbal") < 0, entity_id(F.lit("region"), key)).otherwise(entity_id(F.lit("nation"), key))
    customers = rows.select(entity_id(F.lit("customer"), F.col("c_custkey")).alias(ID), target.alias("x/ref"))
    return mutate.wrong_class(customers, "x/ref", entities(frames), ["tpch/Nation"]).select(F.col(f"`{ID}`").alias("id"))


def _state(spark, sf_dir, *tables) -> plans.State:
    frames, registry = _frames(spark, sf_dir, *tables)
    return plans.State(registry, {t: f for t, f in frames.items()})


@register("migrate_default", f"SELECT {_C} AS id, 42::BIGINT AS grade FROM customer")
def migrate_default(spark, sf_dir):
    state = _state(spark, sf_dir, "customer")
    state.frames = {"tpch/Customer": state.frames["customer"]}
    state = plans.migrate(state, "grades", [("create_attribute", Attribute("tpch/grade", "int")), ("add_attribute", "tpch/Party", "tpch/grade", True, 42)])
    return state.frames["tpch/Customer"].select(F.col(f"`{ID}`").alias("id"), F.col("`tpch/grade`").alias("grade"))


@register("migrate_to_list", f"SELECT {_C} AS id, [c_mktsegment] AS segments FROM customer")
def migrate_to_list(spark, sf_dir):
    state = plans.migrate(_state(spark, sf_dir, "customer"), "lists", [("change_type", "tpch/c_mktsegment", Attribute("tpch/c_mktsegment", "list<string>"))])
    return state.frames["customer"].select(F.col(f"`{ID}`").alias("id"), F.col("`tpch/c_mktsegment`").alias("segments"))


@register("migrate_drop_attribute", f"SELECT {_C} AS id, c_acctbal AS balance, false AS has_segment FROM customer")
def migrate_drop_attribute(spark, sf_dir):
    name = "tpch/c_mktsegment"
    state = plans.migrate(_state(spark, sf_dir, "customer"), "drop", [("remove_attribute", "tpch/Customer", name), ("delete_attribute", name)])
    frame = state.frames["customer"]
    return frame.select(F.col(f"`{ID}`").alias("id"), F.col("`tpch/c_acctbal`").alias("balance"), F.lit(name in frame.columns).alias("has_segment"))


@register("migrate_drop_class", f"SELECT {_C} AS id, 'tpch/Customer' AS class FROM customer")
def migrate_drop_class(spark, sf_dir):
    state = _state(spark, sf_dir, "customer", "supplier")
    state.frames = {"tpch/Customer": state.frames["customer"], "tpch/Supplier": state.frames["supplier"]}
    state = plans.migrate(state, "drop", [("delete_class", "tpch/Supplier")])
    return _show(entities(state.frames)).select("id", "class")


_EVENTS = "SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'replace' WHEN 'error' THEN 'delete' ELSE 'merge' END AS op, user_id::VARCHAR AS id, CASE WHEN event_type IN ('signup', 'purchase') THEN value END AS spent, CASE WHEN event_type <> 'purchase' THEN event_type END AS last_type FROM events"


@register("log_replay", f"""WITH e AS ({_EVENTS}), s AS (SELECT id, coalesce(max(seq) FILTER (op <> 'merge'), -1) AS since FROM e GROUP BY id)
    SELECT e.id, arg_max(spent, seq) FILTER (op <> 'delete' AND spent IS NOT NULL) AS spent, arg_max(last_type, seq) FILTER (op <> 'delete' AND last_type IS NOT NULL) AS last_type
    FROM e JOIN s ON e.id = s.id AND seq >= since GROUP BY e.id HAVING count(*) FILTER (op <> 'delete') > 0""")
def log_replay(spark, sf_dir):
    """The events as a commit log: a signup replaces a user, an error deletes it, others
    merge into it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    op = F.when(kind == "signup", "replace").when(kind == "error", "delete").otherwise("merge")
    as_log = events.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("id"), F.when(kind.isin("signup", "purchase"), F.col("value")).alias("spent"), F.when(kind != "purchase", kind).alias("last_type"))
    return log.replay(as_log, ["spent", "last_type"])


@register("coerce_integers", "SELECT o_orderkey, TRY_CAST(regexp_extract(o_orderpriority, '^[0-9]') AS BIGINT) AS level, CASE WHEN regexp_matches(o_orderpriority, '^[+-]?[0-9]+$') THEN 1::BIGINT END AS whole FROM orders")
def coerce_integers(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", coerce_column(F.regexp_extract("o_orderpriority", "^[0-9]", 0), "int").alias("level"), coerce_column(F.col("o_orderpriority"), "int").alias("whole"))


@register("coerce_mixed", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS whole, CASE WHEN o_orderstatus = 'F' THEN o_orderkey::DOUBLE END AS real, CASE WHEN o_orderstatus = 'P' THEN o_custkey % 2 = 0 END AS flag FROM orders""")
def coerce_mixed(spark, sf_dir):
    """One text column of integers, truth values and other words, as three kinds."""
    status, text = F.col("o_orderstatus"), F.col("mixed")
    mixed = F.when(status == "F", F.col("o_orderkey").cast("string")).when(status == "P", (F.col("o_custkey") % 2 == 0).cast("string")).otherwise(F.col("o_orderpriority"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("mixed", mixed)
    return orders.select("o_orderkey", coerce_column(text, "int").alias("whole"), coerce_column(text, "float").alias("real"), coerce_column(text, "bool").alias("flag"))


@register("moments", "SELECT event_id, epoch_us(ts) // 1000 AS at FROM events")
def moments(spark, sf_dir):
    """Events' times as milliseconds, by way of the moments that these stand for."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", millis(from_millis(millis(F.col("ts").cast("timestamp_ntz")))).alias("at"))


@register("unified_migration", f"SELECT {_id('nation', 'n_nationkey')} AS id, n_name AS name, NULL::BIGINT AS grade FROM nation")
def unified_migration(spark, sf_dir):
    """Nations loaded into a database whose schema is one migration made of three."""
    frames, registry = _frames(spark, sf_dir, "region", "nation")
    grade, spare = Attribute("tpch/grade", "int"), Attribute("tpch/spare", "string")
    first, second, third = ("tables", actions_of(registry)), ("grade", [("create_attribute", grade), ("create_attribute", spare), ("add_attribute", "tpch/Nation", "tpch/grade", False)]), ("spare", [("delete_attribute", "tpch/spare")])
    made = Database(spark)
    made.migrate(*plans.unify([first, second, third], "all"))
    for t in frames:
        made.load(MAPPING[t][0], frames[t])
    return made.select(Select(is_class("tpch/Nation"))).select(F.col(f"`{ID}`").alias("id"), F.col("`tpch/n_name`").alias("name"), F.col("`tpch/grade`").alias("grade"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The richest customers and suppliers: class, range and order over the sparse union."""
    frames, registry = _frames(spark, sf_dir, "customer", "supplier")
    query = Select(inherits("tpch/Party") & (gt(_BALANCE, 5000) | gt(_OTHER, 5000)), [("tpch/c_acctbal", True), ("tpch/s_acctbal", True)], limit=100)
    return _show(run(entities(frames), registry, query), name="tpch/c_name", balance="tpch/c_acctbal")
