"""What the training-data operators share: tables, shared storage, folds and words."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each write inside are deleted once it has ended: what it wrote is read from then on."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor costs no recomputation."""
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def held_out(doc_id: Column, folds: int) -> Column:
    """True where the fold is 1. A row without an id is never learned from, so it counts as held out."""
    return F.coalesce(fold(doc_id, folds) == 1, F.lit(True))


def unit_hash(*cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on the values alone: samples drawn with it are the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


#: Bytes up to which a table of fixed-width columns may be broadcast.
BROADCAST_BYTES = 32 << 20
#: A key with more than this part of all rows is hot. Fewer than as many keys can be, whatever the data.
HOT_PART = 1 / 20_000


def row_bytes(df: DataFrame) -> int:
    """An upper bound of a row's size for columns of fixed width."""
    wide = {"bigint": 8, "double": 8, "int": 4, "boolean": 1, "date": 4, "timestamp": 8}
    return 24 + sum(8 + wide.get(t, 16) for _, t in df.dtypes)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows fit in most bytes; df should be staged and hold numbers. Beyond that, Spark joins by a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes(df) <= most else df


def look_up(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """rows left-joined to a staged table with one row per key and n, the number of rows that have the key.

    A small table is broadcast. Of a larger one only the hot keys are, of which there are at most 1 / HOT_PART by count;
    their rows then meet the rest of the table under a key of their own, so that no key brings many rows into one task.
    """
    size = table.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if size["keys"] * row_bytes(table) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table.drop("n")), on, "left")
    values = [c for c in table.columns if c not in (*on, "n")]
    hot = F.col("n") > size["rows"] * HOT_PART
    common = table.filter(hot).select(*on, F.struct(*values).alias("_hot"))
    rare = table.filter(~hot).select(*[F.col(c).alias(f"_{c}") for c in on], F.struct(*values).alias("_rare"))
    found = rows.join(F.broadcast(common), on, "left").withColumn("_away", F.when(F.col("_hot").isNotNull(), F.xxhash64(*rows.columns)))
    same = F.coalesce(F.col("_away"), F.col(on[0])) == F.col(f"_{on[0]}")
    for c in on[1:]:
        same = same & (F.col(c) == F.col(f"_{c}"))
    met = found.join(rare, same & (F.col("_away").isNull()), "left")
    return met.select(*rows.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_rare.{c}")).alias(c) for c in values])


def unused(columns: list[str], *names: str) -> list[str]:
    """Each name, lengthened until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
