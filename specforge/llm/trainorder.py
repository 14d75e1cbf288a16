"""Token sequences in training order: a keyed Feistel permutation gives every sequence a global slot.

Documents become sequences of a fixed stride (ids, an end id, padding). Once staged they are numbered densely in the order
of doc_id and the text's hash: only a row of numbers per document is sorted, and a document's numbers depend on the
documents alone, not on how the input was cut. A balanced Feistel network over the
next power of four permutes the numbers; values that fall outside are walked on until they are inside, which keeps it a
bijection of [0, n). Slots are dealt to shards by range: shard k holds slots [k * rows, (k + 1) * rows), each row of the
same width, in order. Reading can start at any slot, and the key and the documents alone say what comes next.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, shuffles_freed, small, staged
from .tokens import encoder

SEQUENCE = 512
SHARD_ROWS = 16_384
#: Jobs that write the shards, a range of them each: the shuffle of the ids holds that part of them at a time.
PASSES = 4
END_ID = PAD_ID = 50_256
KEY = 20_240_607
ROUNDS = 4


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def round_keys(key: int) -> list[int]:
    return [int(_mix(np.array([i], np.uint64), key & (2**64 - 1))[0]) for i in range(1, ROUNDS + 1)]


def _half_bits(n: int) -> int:
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of indexes in [0, n)."""
    bits = _half_bits(n)
    half, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    keys = round_keys(key)
    out = index.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> half, out[walk] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        out[walk] = (left << half) | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def invert(slot: np.ndarray, n: int, key: int) -> np.ndarray:
    """The indexes that stand at slots in [0, n)."""
    bits = _half_bits(n)
    half, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    keys = round_keys(key)[::-1]
    out = slot.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> half, out[walk] & mask
        for k in keys:
            left, right = right ^ (_mix(left, k) & mask), left
        out[walk] = (left << half) | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def tokenise(docs: DataFrame, length: int = SEQUENCE, tokenizer: str | None = None) -> DataFrame:
    """doc, doc_id, hash, sequences, start, n_ids, ids: a row per sequence; ids are little-endian 16-bit numbers without padding.

    doc tells input rows apart, hash is the text's, sequences how many the document has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        names = ["doc", "doc_id", "hash", "sequences", "start", "n_ids", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[tuple] = []
                for *key, own in zip(*(part.column(i).to_pylist() for i in (0, 1, 2)), encode(part.column(3).to_pylist()), strict=True):
                    if len(own) and int(np.max(own)) > 0xFFFF:
                        raise ValueError("the tokenizer has ids beyond 16 bits")
                    whole = np.append(own, END_ID).astype("<u2")
                    for a in range(0, len(whole), length):
                        piece = whole[a : a + length]
                        rows.append((*key, -(-len(whole) // length), a, len(piece), piece.tobytes()))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    text = F.col("text").cast("string")
    named = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    return named.mapInArrow(run, "doc long, doc_id long, hash long, sequences long, start long, n_ids int, ids binary")


def first_numbers(sequences: DataFrame) -> DataFrame:
    """doc, first: the number of each document's first sequence, in the order of doc_id and hash. Rows that repeat both are alike."""
    order = ["doc_id", "hash", "doc"]
    docs = sequences.filter("start = 0").select("doc", "doc_id", "hash", "sequences")
    ranged = docs.repartitionByRange(*order).select(F.spark_partition_id().alias("part"), "*")
    ranged = staged(ranged, "order")
    sizes = ranged.groupBy("part").agg(F.sum("sequences").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("sequences").over(Window.partitionBy("part").orderBy(*order)) - F.col("sequences")
    placed = ranged.withColumn("within", within).join(F.broadcast(before), "part")
    return staged(placed.select("doc", (F.col("before") + F.col("within")).alias("first")), "first")


def _placed(docs: DataFrame, key: int, length: int, shard_rows: int, tokenizer: str | None) -> tuple[DataFrame, int]:
    """Every sequence with its slot, shard and row, in no order and without padding, and the number of shards."""
    sequences = staged(tokenise(docs, length, tokenizer), "sequences")
    n = sequences.count()

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), n, key))

    placed = sequences.join(small(first_numbers(sequences)), "doc").withColumn("slot", slot(F.col("first") + F.floor(F.col("start") / length)))
    placed = placed.select("slot", F.floor(F.col("slot") / shard_rows).cast("int").alias("shard"), (F.col("slot") % shard_rows).cast("int").alias("row"), "doc_id", "start", "n_ids", "ids")
    return placed, max(1, -(-n // shard_rows))


def _ordered(placed: DataFrame, first: int, shards: int, length: int) -> DataFrame:
    """The sequences of shards from first on, a shard to a partition, in slot order and padded."""
    ordered = placed.repartitionById(shards, F.col("shard") - first).sortWithinPartitions("shard", "slot")
    padding = np.array([PAD_ID], "<u2").tobytes().hex()
    return ordered.withColumn("ids", F.expr(f"rpad(ids, {2 * length}, X'{padding}')"))


def materialise(docs: DataFrame, key: int = KEY, length: int = SEQUENCE, shard_rows: int = SHARD_ROWS, tokenizer: str | None = None) -> DataFrame:
    """slot, shard, row, doc_id, start, n_ids, ids: every sequence once, padded, shards in partitions, rows in slot order.

    Null and empty texts are a sequence with the end id alone; a null doc_id stays null; repeated rows have sequences of
    their own; a very long text has as many as it needs. An empty table gives no rows. Other columns are ignored.
    """
    placed, shards = _placed(docs, key, length, shard_rows, tokenizer)
    return _ordered(placed, 0, shards, length)


def write_shards(sequences: DataFrame, path: str, shards: list[int] | None = None) -> None:
    """One uncompressed file per shard, rows of one width in slot order. A second attempt at a task replaces the first.

    With shards, only those are written, in place of what stands there; the others stay as they are.
    """
    own = sequences if shards is None else sequences.filter(F.col("shard").isin(shards)).sortWithinPartitions("shard", "slot")
    mode = "static" if shards is None else "dynamic"
    _write(own, path, mode)


def _write(own: DataFrame, path: str, mode: str) -> None:
    with shuffles_freed(own.sparkSession):
        own.write.mode("overwrite").option("partitionOverwriteMode", mode).option("compression", "none").option("parquet.enable.dictionary", "false").partitionBy("shard").parquet(path)


def sharded(docs: DataFrame, key: int = KEY, length: int = SEQUENCE, shard_rows: int = SHARD_ROWS, tokenizer: str | None = None) -> DataFrame:
    """The rows of materialise(), from shards written to the shared folder and read back; files are in slot order, the rows of the table in none.

    The shards are written in PASSES jobs. One that failed can be repeated without the others: it replaces its own shards.
    """
    placed, shards = _placed(docs, key, length, shard_rows, tokenizer)
    path = os.path.join(shared_dir(docs.sparkSession), f"shards-{uuid.uuid4().hex}")
    each = -(-shards // PASSES)
    for first in range(0, shards, each):
        count = min(each, shards - first)
        own = placed.filter((F.col("shard") >= first) & (F.col("shard") < first + count))
        _write(_ordered(own, first, count, length), path, "dynamic")
    return docs.sparkSession.read.schema(placed.schema).parquet(path).select(*placed.columns)


def read_from(spark: SparkSession, path: str, slot: int, rows: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """rows sequences from a slot on, in order: only the shards that hold them are opened."""
    last = slot + rows - 1
    shards = F.col("shard").between(slot // shard_rows, last // shard_rows)
    return spark.read.parquet(path).filter(shards & F.col("slot").between(slot, last)).orderBy("slot")
