"""A commit log as JSON lines, and its replay.

An event is (seq, op, id, data): op is create, replace, merge or delete, data the
attributes as JSON text. Replay needs no ordered fold: per entity the last create,
replace or delete resets it; of the merges since then each attribute keeps the last
given value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("id", T.StringType()), T.StructField("data", T.StringType())])


def append(events: DataFrame, path: str) -> None:
    """One folder of files per commit; readers see a commit when its files are in place."""
    events.select(*EVENT.names).write.mode("append").json(path)


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Events from ``first`` to ``last``, both included."""
    out = spark.read.schema(EVENT).json(path)
    out = out if first is None else out.where(F.col("seq") >= first)
    return out if last is None else out.where(F.col("seq") <= last)


def parsed(events: DataFrame, attributes: T.StructType) -> DataFrame:
    return events.select("seq", "op", "id", F.from_json("data", attributes).alias("data")).select("seq", "op", "id", "data.*")


def replay(events: DataFrame, attributes: list[str]) -> DataFrame:
    """Entities (id and attributes) after all events; ``events`` has seq, op, id and the
    attributes as columns. All aggregates combine on the map side, so that a busy id
    needs no task of its own."""
    resets = F.col("op") != "merge"
    last = events.groupBy("id").agg(F.coalesce(F.max(F.when(resets, F.col("seq"))), F.lit(-1).cast("long")).alias("since"))
    live = events.join(last, "id").where(F.col("seq") >= F.col("since"))
    given = [F.max(F.when((F.col("op") != "delete") & F.col(f"`{a}`").isNotNull(), F.struct("seq", F.col(f"`{a}`").alias("v"))))["v"].alias(a) for a in attributes]
    final = live.groupBy("id").agg(*given, F.max(F.when(F.col("op") != "delete", F.col("seq"))).alias("_alive"))
    return final.where("_alive IS NOT NULL").drop("_alive")
