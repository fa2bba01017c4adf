"""A durable database's folder: commits as JSON lines, and class frames as Parquet.

Every commit is one row: its version, its events, the registry after it, and where each
class frame lies. A commit writes the frames that it changed, then its row; readers take
the row with the highest version, so that a commit is there whole or not at all. Frames
are never changed. The events alone suffice to build the database again.
"""

from __future__ import annotations

import datetime
import json
import tempfile
import uuid
from dataclasses import asdict
from decimal import Decimal
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.expressions import Expr
from ..operators.mutate import Change
from ..schema import Attribute, EntityClass, SchemaError

COMMIT = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("events", T.StringType()), T.StructField("registry", T.StringType()),
    T.StructField("frames", T.MapType(T.StringType(), T.StringType())), T.StructField("applied", T.ArrayType(T.StringType())),
])


class ConflictError(SchemaError):
    """Another writer has committed since this database was opened."""


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share: ``spark.checkpoint.dir``,
    or a temporary one where that is unset (one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lodestore-")
    return f"{named.rstrip('/')}/lodestore-db-{uuid.uuid4().hex}"


def encode(x: Any) -> Any:
    """A value of an event as JSON data; what JSON lacks is a map with one key."""
    match x:
        case Expr():
            return {"expr": [x.op, *map(encode, x.args)]}
        case Change():
            return {"change": [x.op, *map(encode, x.args)]}
        case Attribute():
            return {"attribute": asdict(x)}
        case EntityClass():
            return {"class": asdict(x)}
        case bytes():
            return {"bytes": x.hex()}
        case datetime.datetime():
            return {"moment": x.isoformat()}
        case Decimal() | uuid.UUID():
            return str(x)
        case dict():
            return {"map": {k: encode(v) for k, v in x.items()}}
        case list() | tuple():
            return [encode(v) for v in x]
    return x


def decode(x: Any) -> Any:
    if isinstance(x, list):
        return [decode(v) for v in x]
    if not isinstance(x, dict):
        return x
    [(kind, v)] = x.items()
    match kind:
        case "expr":
            return Expr(v[0], tuple(map(decode, v[1:])))
        case "change":
            return Change(v[0], tuple(map(decode, v[1:])))
        case "attribute":
            return Attribute(**v | {"classes": tuple(v["classes"]), "allowed": tuple(v["allowed"])})
        case "class":
            return EntityClass(**v | {"extends": tuple(v["extends"])})
        case "bytes":
            return bytes.fromhex(v)
        case "moment":
            return datetime.datetime.fromisoformat(v)
    return {k: decode(y) for k, y in v.items()}


def commits(spark: SparkSession, path: str) -> DataFrame:
    """All commits; none where the folder is new."""
    try:
        return spark.read.schema(COMMIT).json(f"{path}/commits")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], COMMIT)


def head(spark: SparkSession, path: str, version: int | None = None):
    """The last commit's row, or that of a version; None if there is none."""
    found = commits(spark, path)
    found = found if version is None else found.where(found["version"] <= version)
    return found.orderBy(found["version"].desc()).first()


def write_frame(frame: DataFrame, path: str) -> tuple[str, DataFrame]:
    place = f"{path}/frames/{uuid.uuid4().hex}"
    frame.write.parquet(place)
    return place, read_frame(frame.sparkSession, place)


def read_frame(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.parquet(place)


def append(spark: SparkSession, path: str, version: int, events: list, registry: str, frames: dict[str, str], applied: tuple[str, ...]) -> None:
    last = head(spark, path)
    if (last["version"] if last else 0) != version - 1:
        raise ConflictError(f"version {version} exists")
    row = (version, json.dumps(encode(events)), registry, frames, list(applied))
    spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("append").json(f"{path}/commits")
