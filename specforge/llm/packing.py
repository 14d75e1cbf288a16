"""Packing documents into fixed windows by the sum-of-squares rule.

A document's ids are cut at multiples of the window; what remains is placed online. For fill levels h with N(h) open
windows, the rule picks the level whose choice makes the sum over h of N(h)^2 smallest, the fuller window on ties. The
levels are one array. Documents are dealt to shards by a hash, so that any number of them pack in parallel; each shard
is a bounded list of piece lengths, never of texts or ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .tokens import encoder

WINDOW = 2048
END_ID = 1
SHARD_DOCS = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, shard_key long"


def sum_of_squares(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset of each size (1 to window), in order of arrival."""
    count = np.zeros(window + 1)
    count[0], count[window] = 0.5, -0.5  # a new window and a full one add one square, not two
    held: list[list[int]] = [[] for _ in range(window + 1)]
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    opened = 0
    for i, s in enumerate(sizes.tolist()):
        last = window - s
        gain = np.where(count[: last + 1] > 0, count[s : window + 1] - count[: last + 1], np.inf)
        h = last - int(np.argmin(gain[::-1]))
        if h:
            count[h] -= 1
            own = held[h].pop()
        else:
            own, opened = opened, opened + 1
        where[i], offset[i] = own, h
        if h + s < window:
            count[h + s] += 1
            held[h + s].append(own)
    return where, offset


def _cut(path: str | None, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows: list[tuple] = []
            for doc, key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids = np.concatenate((ids, end)).astype("<u4")
                for a in range(0, len(ids), window):
                    part = ids[a : a + window]
                    rows.append((doc, a, len(part), zlib.crc32(part), len(ids), key))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "shard_key"])

    return run


def _place(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32", "doc_tokens"], ignore_index=True, na_position="last")
        whole = (pdf["length"] == window).to_numpy()
        where, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        where[~whole], offset[~whole] = sum_of_squares(pdf["length"].to_numpy()[~whole], window)
        packed = int(where[~whole].max()) + 1 if (~whole).any() else 0
        where[whole] = packed + np.arange(whole.sum())
        pdf["sequence_id"] = (pdf["shard"].to_numpy(np.int64) << 32) + where
        pdf["offset"] = offset
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. A null doc_id stays null; repeated rows are packed each on its own. An
    empty table gives no rows. Other columns are ignored. A very long text gives whole windows and one remainder.
    shard_docs bounds what one task packs; the windows left open at its end are a few per shard.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = named.withColumn("shard_key", F.xxhash64("doc_id", "text"))
    pieces = staged(keyed.mapInArrow(_cut(tokenizer, window, end_id), PIECES), "pieces")
    shards = max(1, -(-pieces.filter("start = 0").count() // shard_docs))
    dealt = pieces.withColumn("shard", F.pmod("shard_key", F.lit(shards))).drop("shard_key")
    return dealt.groupBy("shard").applyInPandas(_place(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per sequence: its pieces in order, its ids and its padding (none at a power of two)."""
    filled = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length"))).alias("pieces"), F.sum("length").alias("filled"))
    return filled.withColumn("padding", F.when(F.bit_count("filled") == 1, F.lit(0)).otherwise(F.lit(window) - F.col("filled")))
