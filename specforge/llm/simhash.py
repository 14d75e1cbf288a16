"""SimHash near-duplicates through pivot distance tables.

Each distinct fingerprint gets its Hamming distances to many reference fingerprints (pivots). The pivots stand in six
groups, each confined to a block of bits of its own; minus the distance to the zero pivot, the distances of a group
depend on its block alone. Two fingerprints that differ in three bits or fewer leave three groups untouched, so they
agree in all distance differences of at least one of the twenty triples of groups: those coordinates are the key under
which candidates meet. Candidates whose coordinates differ by more than the radius anywhere are discarded, and
survivors are verified on the bits. Nothing is lost: each step only drops pairs that cannot be within the radius.

A key that very many fingerprints share is cut into blocks, and pairs of blocks meet in tasks of bounded size. A task
returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import look_up, shuffle_parts, small, staged, unused
from .graph import components

RADIUS = 3
SHINGLE = 3
GROUPS = 6
PER_GROUP = 10
BLOCK_ROWS = 1024
SEED = 42


TRIPLES = list(itertools.combinations(range(GROUPS), GROUPS - RADIUS))


@functools.lru_cache(maxsize=1)
def pivots() -> np.ndarray:
    """The reference fingerprints, by group of bits; fixed by a seed."""
    draw = np.random.default_rng(17)
    blocks = np.array_split(np.arange(64), GROUPS)
    return np.array([[sum(1 << int(b) for b in bits if draw.random() < 0.5) for _ in range(PER_GROUP)] for bits in blocks], np.uint64)


def distances(fp: np.ndarray) -> np.ndarray:
    """The pivot table of fingerprints: a row of Hamming distances to all pivots each, and to zero in the last column."""
    return np.bitwise_count(fp[:, None] ^ np.append(pivots().ravel(), np.uint64(0))[None, :]).astype(np.int8)


def keys(table: np.ndarray) -> np.ndarray:
    """For each triple of groups, a hash of the coordinates that an untouched triple fixes."""
    fixed = (table[:, :-1] - table[:, -1:]).view(np.uint8).astype(np.uint64).reshape(len(table), GROUPS, PER_GROUP)
    weight = np.random.default_rng(23).integers(1, 1 << 63, (len(TRIPLES), GROUPS - RADIUS, PER_GROUP), dtype=np.uint64) | np.uint64(1)
    return np.stack([(fixed[:, list(t)] * weight[n]).sum(axis=(1, 2), dtype=np.uint64) for n, t in enumerate(TRIPLES)], axis=1)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text, unsigned; zero where it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)], strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    n = max(1, len(words) - SHINGLE + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        part = h[a : a + (1 << 16)]
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, rk (a hash of the text, for rows that repeat an id), fp (the fingerprint as a signed long)."""

    @F.pandas_udf("long")
    def own(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("rk"), own(text).alias("fp"))


def pivot_table(distinct: DataFrame) -> DataFrame:
    """fp, d (its distances to all pivots, a byte each) and the keys under which it meets candidates."""

    @F.pandas_udf("d binary, keys array<long>")
    def row(fp: pd.Series) -> pd.DataFrame:
        table = distances(fp.to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"d": [x.tobytes() for x in table], "keys": list(keys(table).view(np.int64))})

    return distinct.select("fp", row("fp").alias("x")).select("fp", "x.*")


def _forest(fp: np.ndarray, d: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect what the radius connects among the rows of one key."""
    m = len(fp)
    label = np.arange(m)
    near = np.zeros((m, m), bool)
    for i in range(0, m, 256):
        apart = np.abs(d[i : i + 256, None, :] - d[None, :, :]).max(axis=2) <= RADIUS
        r, c = np.nonzero(apart)
        close = np.bitwise_count(fp[i + r] ^ fp[c]) <= RADIUS
        near[i + r[close], c[close]] = True
    while True:
        least = np.where(near, label[None, :], m).min(axis=1)
        least = np.minimum(least, label)
        if (least == label).all():
            break
        label = least
    for i in np.flatnonzero(label != np.arange(m)).tolist():
        yield i, int(label[i])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among consecutive rows of one key; rows come sorted by key and block pair."""
    held: pd.DataFrame | None = None

    def run(pdf: pd.DataFrame) -> pa.RecordBatch:
        key = pdf["key"].to_numpy()
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        d = np.frombuffer(b"".join(pdf["d"]), np.int8).reshape(len(pdf), -1)
        edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (pdf["pair"].to_numpy()[1:] != pdf["pair"].to_numpy()[:-1]), [True])))
        size = np.diff(edge)
        a, b = [], []
        most = 8
        small = np.repeat(np.where(size <= most, edge[1:], 0), size)  # the end of each row's own short run
        for offset in range(1, most):
            i = np.flatnonzero(np.arange(len(fp)) + offset < small)
            i = i[(np.abs(d[i] - d[i + offset]).max(axis=1) <= RADIUS)] if len(i) else i
            i = i[np.bitwise_count(fp[i] ^ fp[i + offset]) <= RADIUS]
            a.append(fp[i]), b.append(fp[i + offset])
        for s, e in zip(edge[:-1][size > most].tolist(), edge[1:][size > most].tolist(), strict=True):
            found = list(_forest(fp[s:e], d[s:e]))
            if found:
                x, y = np.array(found).T
                a.append(fp[s + x]), b.append(fp[s + y])
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        pdf = batch.to_pandas()
        if not len(pdf):
            continue
        pdf = pdf if held is None else pd.concat((held, pdf), ignore_index=True)
        last = pdf.iloc[-1]
        open_ = int(((pdf["key"] == last["key"]) & (pdf["pair"] == last["pair"])).to_numpy()[::-1].cumprod().sum())
        held = pdf.iloc[len(pdf) - open_ :].reset_index(drop=True)
        if open_ < len(pdf):
            yield run(pdf.iloc[: len(pdf) - open_])
    if held is not None:
        yield run(held)


def links(distinct: DataFrame) -> DataFrame:
    """a, b: fingerprints within the radius of each other, enough of them to connect all that are."""
    spark = distinct.sparkSession
    pivoted = staged(pivot_table(distinct), "pivots")
    keyed = pivoted.select("fp", "d", F.explode("keys").alias("key"))
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = met.select("key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    shared = keyed.join(blocks, "key")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.transform(other, lambda o: F.least(o, own) * F.col("blocks") + F.greatest(o, own)))
    dealt = shared.select("fp", "d", "key", F.explode(pairs).alias("pair"))
    spread = dealt.repartition(shuffle_parts(spark), "key", "pair").sortWithinPartitions("key", "pair", "fp")
    return spread.select("key", "pair", "fp", "d").mapInArrow(_links, "a long, b long").distinct()


def _roots(prints: DataFrame) -> DataFrame:
    """fp, root, n (rows of the fingerprint): the component of each distinct fingerprint."""
    distinct = staged(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "distinct")
    found = components(links(distinct.select("fp")))
    return staged(distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "n"), "roots")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id that links reach, its own included), component_size.

    Texts without a word, null ones too, have fingerprint zero and link like any other. Repeated rows share their
    component. A null doc_id keeps its row and counts for no minimum. Very long texts are read whole; of equal minima
    there is but one. An empty table gives no rows. Other columns are ignored.
    """
    prints = staged(fingerprints(docs).select("doc_id", "fp"), "fingerprints")
    roots = _roots(prints)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    named = staged(roots.join(least, "root").select("fp", "component_id", "component_size", "n"), "named")
    return look_up(prints, named, ["fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates: the smallest doc_id, rows without one last, by the text's hash on ties.

    Rows are told apart by doc_id and text, so a row stays whose id another text shares. Of rows that repeat both, the
    one with the least hash of all its columns stays. Null and empty texts are one group. An empty table stays empty;
    very long texts are read whole; other columns are kept, whatever their names.
    """
    prints = staged(fingerprints(docs), "fingerprints")
    roots = _roots(prints.select("fp"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk")
    first = prints.groupBy("fp").agg(F.min(order).alias("first")).join(roots, "fp").groupBy("root").agg(F.min("first").alias("first"))
    firsts = staged(roots.join(first, "root").select("fp", "n", F.col("first.doc_id").alias("first_id"), F.col("first.rk").alias("first_rk")), "firsts")
    judged = look_up(prints, firsts, ["fp"])
    own_id, own_rk, rk, key, all_ = unused(docs.columns, "own_id", "own_rk", "rk", "key", "all")
    gone = judged.filter(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("rk") == F.col("first_rk"))))
    gone = staged(gone.select(F.col("doc_id").alias(own_id), F.col("rk").alias(own_rk)).distinct(), "gone")
    keyed = docs.withColumns({rk: F.xxhash64(F.col("text").cast("string")), key: F.col("doc_id").cast("long")})
    same = keyed[key].eqNullSafe(gone[own_id]) & (keyed[rk] == gone[own_rk])
    kept = keyed.join(small(gone), same, "left_anti")
    again = judged.groupBy("doc_id", "rk").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = staged(again.select(F.col("doc_id").alias(own_id), F.col("rk").alias(own_rk)), "again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    same = kept[key].eqNullSafe(again[own_id]) & (kept[rk] == again[own_rk])
    several = kept.join(small(again), same, "left_semi").withColumn(all_, F.xxhash64(*[F.to_json(F.struct(c)) for c in docs.columns]))
    best = several.groupBy(key, rk).agg(F.min_by(F.struct(*docs.columns), F.col(all_)).alias(all_)).select(f"{all_}.*")
    return kept.join(small(again), same, "left_anti").select(*docs.columns).unionByName(best)
