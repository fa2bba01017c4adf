"""Class frames over the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import entity_id
from ..schema import ID, IDENT, TYPE, Attribute, EntityClass, Registry

#: Table -> class, parents, key columns, reference columns (column -> table).
MAPPING = {
    "region": ("tpch/Region", (), ("r_regionkey",), {}),
    "nation": ("tpch/Nation", (), ("n_nationkey",), {"n_regionkey": "region"}),
    "customer": ("tpch/Customer", ("tpch/Party",), ("c_custkey",), {"c_nationkey": "nation"}),
    "supplier": ("tpch/Supplier", ("tpch/Party",), ("s_suppkey",), {"s_nationkey": "nation"}),
    "part": ("tpch/Part", (), ("p_partkey",), {}),
    "orders": ("tpch/Order", (), ("o_orderkey",), {"o_custkey": "customer"}),
    "lineitem": ("tpch/LineItem", (), ("l_orderkey", "l_linenumber"), {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "documents": ("doc/Document", (), ("doc_id",), {}),
    "benchmark": ("doc/Item", (), ("item_id",), {}),
    "pages": ("web/Page", (), ("page_id",), {}),
    "labels": ("label/Label", (), ("doc_id",), {"doc_id": "documents"}),
    "conversations": ("chat/Turn", (), ("conv_id", "turn"), {}),
    "events": ("web/Event", (), ("event_id",), {}),
    "embeddings": ("doc/Embedding", (), ("vec_id",), {}),
}
_NAMES = {"bigint": "int", "int": "int", "double": "float", "float": "float", "string": "string", "timestamp_ntz": "datetime", "boolean": "bool"}


def prefixed(table: str, column: str) -> str:
    return f"{MAPPING[table][0].split('/')[0]}/{column}"


def class_frame(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One entity per row: its id, class, ident (table and key) and all columns as
    attributes; reference columns also give the id that they name, as ``<column>_ref``."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    name, _, keys, references = MAPPING[table]
    ident = F.concat_ws("-", F.lit(table), *(F.col(k).cast("string") for k in keys))
    columns = [entity_id(F.lit(table), *map(F.col, keys)).alias(ID), F.lit(name).alias(TYPE), ident.alias(IDENT)]
    for f in rows.schema:
        wide = "array<double>" if isinstance(f.dataType, T.ArrayType) else {"int": "bigint", "float": "double"}.get(f.dataType.simpleString(), f.dataType.simpleString())
        columns.append(F.col(f.name).cast(wide).alias(prefixed(table, f.name)))
    columns += [F.when(F.col(c).isNotNull(), entity_id(F.lit(t), F.col(c))).alias(prefixed(table, f"{c}_ref")) for c, t in references.items()]
    return rows.select(*columns)


def registry_of(frames: dict[str, DataFrame]) -> Registry:
    """A registry that describes class frames of the tables."""
    registry = Registry().with_class(EntityClass("tpch/Party"))
    for table, frame in frames.items():
        name, parents, _, _ = MAPPING[table]
        own = {}
        for f in frame.schema:
            if f.name.startswith("core/"):
                continue
            kind = f"list<{_NAMES[f.dataType.elementType.simpleString()]}>" if isinstance(f.dataType, T.ArrayType) else _NAMES[f.dataType.simpleString()]
            registry = registry.with_attribute(Attribute(f.name, "ref" if f.name.endswith("_ref") else kind))
            own[f.name] = False
        registry = registry.with_class(EntityClass(name, own | {IDENT: False}, parents))
    return registry


def actions_of(registry: Registry) -> list[tuple]:
    """The migration that brings in what a registry has beyond a new one."""
    new = Registry()
    attributes = [("create_attribute", a) for k, a in registry.attributes.items() if k not in new.attributes]
    return [*attributes, *(("create_class", c) for c in registry.classes.values())]
