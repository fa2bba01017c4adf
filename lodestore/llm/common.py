"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The first word class of the data contracts (Java regex syntax).
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def other_than(characters: str) -> str:
    """Runs of other characters than these, which are listed one by one: Java looks such a
    class up in one table, where it tests ranges in turn (a seventh of the time)."""
    return "[^" + "".join(rf"\x{ord(c):02X}" for c in characters) + "]+"


#: The second word class, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, and the same with A-Z in words.
ALNUM_WORD = other_than("".join(c for c in map(chr, range(128)) if not c.isdigit() and not c.islower()))
ANY_CASE_WORD = other_than("".join(c for c in map(chr, range(128)) if not c.isalnum()))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Clusters name it in ``spark.checkpoint.dir``. Only where that is unset (tests,
    one machine) is a temporary folder made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Each action inside drops its shuffle files when it ends. Otherwise they stay until the
    driver happens to collect its garbage, and those of a long run of actions pile up. For
    actions whose plans don't run again."""
    before = spark.conf.get(_FILE_CLEANUP, None)
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FILE_CLEANUP)
        else:
            spark.conf.set(_FILE_CLEANUP, before)


_written: list[str] = []


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: this cuts the
    lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/lodestore-{label}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables there are; ``discard`` takes it to drop those written since."""
    return len(_written)


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables that ``materialise`` wrote, but for the first ``since`` and the
    last ``keep``: for when all that was read from them is written. A caller of a query
    does so when its result is stored."""
    end = max(since, len(_written) - keep)
    for name in _written[since:end]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _written[since:end]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_id(column: str) -> Column:
    """A long id as text: a nullable long in a pandas batch would become a float and lose
    its last digits."""
    return F.col(column).cast("long").cast("string").alias(column)


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone, as the contracts ask (F.lower folds all of Unicode)."""
    return F.translate(text, UPPER, LOWER)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have in any case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = "_" + name
    return name
