"""Hard negatives by exact integer scores.

Scores are inner products of integer vectors, computed modulo several small primes as float32 matrix products: residues
lie in -125 to 125, so 1024 products add up to less than 2^24 and nothing rounds. The balanced digits of the mixed-radix
form then give the signed score. As many primes are taken as the largest vector needs (Cauchy-Schwarz).

Rows are packed into blocks of bounded size, anchors are dealt to groups of bounded size, and each pair of a block and
a group is one cell of work: it gives its best rows of each anchor, and a window over the cells' answers the best of all.
The second pass does the same for the rows whose score lies in the window that an anchor and its positive span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199, 197, 193, 191)
INNER = 1024
BLOCK_ROWS, BLOCK_BYTES = 8192, 8 << 20
GROUP_ANCHORS, SLICE = 2048, 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
BLOCKS = "block long, n int, width int, kind string, reach double, ids binary, no_id binary, labels binary, parts binary"
ANCHORS = "a_block long, a_place int, anchor_id long, a_label long, a_kind string, a_parts binary"


def primes_for(bound: int) -> list[int]:
    """The first primes whose product exceeds twice the bound."""
    product, taken = 1, []
    for p in PRIMES:
        if product > 2 * bound + 1:
            break
        taken.append(p)
        product *= p
    return taken


def residues(parts: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [((parts + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def scores(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The exact products of all rows of left with all of right, from their residues."""
    value, place = np.zeros((len(left[0]), len(right[0])), np.int64), 1
    for a, b, p in zip(left, right, primes, strict=True):
        rest = np.zeros(value.shape, np.int32)
        for k in range(0, a.shape[1], INNER):
            rest += (a[:, k : k + INNER] @ b[:, k : k + INNER].T).astype(np.int32) % p
        digit = (rest - (value % p).astype(np.int32)) * pow(place, -1, p) % p
        value += np.where(digit > p // 2, digit - p, digit).astype(np.int64) * place
        place *= p
    return value


def top(values: np.ndarray, most: int) -> np.ndarray:
    """Places of the largest values, the first of equal ones first."""
    if len(values) > most:
        least = np.partition(values, len(values) - most)[len(values) - most]
        above = np.flatnonzero(values > least)
        found = np.concatenate((above, np.flatnonzero(values == least)[: most - len(above)]))
    else:
        found = np.arange(len(values))
    return found[np.lexsort((found, -values[found]))]


def _widened(parts: np.ndarray, width: int) -> np.ndarray:
    return np.pad(parts, ((0, 0), (0, width - parts.shape[1])))


def _packed(part: int, number: int, ids: list, labels: list, vectors: list) -> dict:
    width = max(map(len, vectors))
    parts = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(parts, vectors, strict=True):
        row[: len(v)] = v
    missing = np.array([i is None for i in ids])
    known = np.array([0 if i is None else i for i in ids], np.int64)
    order = np.lexsort((known, missing))
    most = int(max(parts.max(initial=0), -(parts.min(initial=0) + 1)))
    kind = next(k for k in ("<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
    reach = float((parts.astype(float) ** 2).sum(axis=1).max())
    own = (parts[order].astype(kind), missing[order], known[order], np.array(labels, np.int64)[order])
    return {"block": part << 32 | number, "n": len(ids), "width": width, "kind": kind, "reach": reach, "ids": own[2].tobytes(), "no_id": own[1].tobytes(), "labels": own[3].tobytes(), "parts": own[0].tobytes()}


def _pack(block_rows: int):
    kinds = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), ("reach", pa.float64()), *((c, pa.binary()) for c in ("ids", "no_id", "labels", "parts"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0
        for row in (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            held.append(row)
            size += 8 * len(row[2])
            if len(held) == block_rows or size > BLOCK_BYTES:
                yield pa.RecordBatch.from_pylist([_packed(part, number, *zip(*held, strict=True))], kinds)
                held, size, number = [], 0, number + 1
        if held:
            yield pa.RecordBatch.from_pylist([_packed(part, number, *zip(*held, strict=True))], kinds)

    return run


def _anchors(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids, missing = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["no_id"], bool)
                at = np.flatnonzero((ids % every == 0) & ~missing)
                own = np.frombuffer(b["parts"], b["kind"]).reshape(b["n"], b["width"])[at]
                columns = [pa.array(np.full(len(at), b["block"])), pa.array(at.astype(np.int32)), pa.array(ids[at]), pa.array(np.frombuffer(b["labels"], np.int64)[at]), pa.array([b["kind"]] * len(at), pa.string()), pa.array([v.tobytes() for v in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["a_block", "a_place", "anchor_id", "a_label", "a_kind", "a_parts"])

    return run


def _each(blocks: pd.DataFrame, anchors: pd.DataFrame, primes: list[int], width: int) -> Iterator[tuple]:
    """For each anchor and block: the anchor's row, the block, and the scores of the block's rows."""
    for b in blocks.itertuples():
        ids, labels = np.frombuffer(b.ids, np.int64), np.frombuffer(b.labels, np.int64)
        own = np.frombuffer(b.parts, b.kind).reshape(b.n, b.width).astype(np.int64)
        right = residues(_widened(own, width), primes)
        names = [None if gone else i for i, gone in zip(ids.tolist(), np.frombuffer(b.no_id, bool).tolist(), strict=True)]
        for k in range(0, len(anchors), SLICE):
            rows = anchors.iloc[k : k + SLICE]
            vectors = [np.frombuffer(v, kind) for v, kind in zip(rows["a_parts"], rows["a_kind"], strict=True)]
            matrix = np.zeros((len(rows), width), np.int64)
            for row, v in zip(matrix, vectors, strict=True):
                row[: len(v)] = v
            found = scores(residues(matrix, primes), right, primes)
            for a, s in zip(rows.itertuples(), found, strict=True):
                yield a, b.block, names, labels, s


POSITIVE = "a_block long, a_place int, positive_id long, positive_score long, block long, place int"
NEGATIVE = "a_block long, a_place int, anchor_id long, number int, positive_id long, positive_score long, negative_id long, negative_score long, block long, place int"


def _positives(primes: list[int], width: int, most: int):
    def run(blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, block, names, labels, s in _each(blocks, anchors, primes, width):
            fits = labels == a.a_label
            if block == a.a_block:
                fits[a.a_place] = False
            at = np.flatnonzero(fits)
            for i in at[top(s[at], most)].tolist():
                out.append((a.a_block, a.a_place, names[i], int(s[i]), block, i))
        return _frame(out, POSITIVE)

    return run


def _negatives(primes: list[int], width: int, most: int, low: int, high: int):
    def run(blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, block, names, labels, s in _each(blocks, anchors, primes, width):
            other = np.flatnonzero(labels != a.a_label)
            scored = 100 * s[other]
            for number, positive, score in zip(a.numbers, a.positives, a.positive_scores, strict=True):
                at = other[(scored >= low * score) & (scored <= high * score)]
                for i in at[top(s[at], most)].tolist():
                    out.append((a.a_block, a.a_place, a.anchor_id, number, positive, score, names[i], int(s[i]), block, i))
        return _frame(out, NEGATIVE)

    return run


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Whole columns of nullable numbers: an id may be null and must not pass through floats."""
    kinds = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pd.DataFrame({name: pd.array(list(c), dtype="Int32" if kind == "int" else "Int64") for (name, kind), c in zip(kinds, columns, strict=True)})


def mine(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS, group_anchors: int = GROUP_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; vectors hold vec_id, label, parts.

    parts are integers (array<long>). Rows with a null label, a null vector or a null part take no part. Anchors are
    the rows whose vec_id is divisible by every. An anchor's positives are its best other rows of its label; for each,
    the best rows of other labels with low * positive <= 100 * negative <= high * positive follow. Higher scores come
    first, ties by smaller vec_id, a null vec_id after all others; it is never an anchor. Repeated rows count each:
    a repeated anchor is asked twice, and its copy is another row. Shorter vectors count as filled with zeros. An empty
    table gives no rows; other columns are ignored. Scores whose hundredfold leaves 64 bits are refused with an error.
    """
    spark = vectors.sparkSession
    valid = F.col("label").isNotNull() & F.col("parts").isNotNull() & F.forall("parts", lambda x: x.isNotNull())
    rows = vectors.filter(valid).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("parts").cast("array<bigint>"))
    blocks = staged(rows.mapInArrow(_pack(block_rows), BLOCKS), "vector-blocks")
    size = blocks.agg(F.sum("n").alias("n"), F.max("width").alias("width"), F.max("reach").alias("reach")).first()
    if not size["n"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    bound = int(size["reach"] * (1 + 1e-9)) + 1
    if max(100, abs(low), abs(high)) * bound >= 1 << 63:
        raise ValueError("scores do not fit 64 bits")
    primes, width = primes_for(bound), max(1, size["width"])
    anchors = staged(blocks.mapInArrow(_anchors(every), ANCHORS), "anchors")
    groups, cells = max(1, -(-anchors.count() // group_anchors)), max(1, -(-size["n"] // block_rows))
    dealt_blocks = blocks.withColumn("row", F.pmod(F.xxhash64("block"), F.lit(cells))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def met(asked: DataFrame, body, schema: str) -> DataFrame:
        """Every block with every group of anchors, a cell each."""
        dealt = asked.withColumn("col", F.pmod(F.xxhash64("a_block", "a_place"), F.lit(groups)).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
        return dealt_blocks.groupBy("row", "col").cogroup(dealt.groupBy("row", "col")).applyInPandas(body, schema)

    def first(df: DataFrame, keys: list[str], score: str, name: str, most: int, number: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last(name), "block", "place")
        return df.withColumn(number, F.row_number().over(order)).filter(F.col(number) <= most)

    near = first(met(anchors, _positives(primes, width, positives), POSITIVE), ["a_block", "a_place"], "positive_score", "positive_id", positives, "number")
    listed = near.groupBy("a_block", "a_place").agg(F.array_sort(F.collect_list(F.struct("number", "positive_id", "positive_score"))).alias("p"))
    asked = anchors.join(listed, ["a_block", "a_place"]).select(*anchors.columns, F.col("p.number").alias("numbers"), F.col("p.positive_id").alias("positives"), F.col("p.positive_score").alias("positive_scores"))
    found = met(staged(asked, "asked"), _negatives(primes, width, negatives, low, high), NEGATIVE)
    return first(found, ["a_block", "a_place", "number"], "negative_score", "negative_id", negatives, "rank").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def whole_parts(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where any is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))
