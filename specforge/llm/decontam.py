"""Benchmark decontamination in DataFrame functions only.

A passage is a copy of a benchmark item if its five-word shingles, counted as often as they occur, are similar to the
item's by 0.8 or more (sum of minima over sum of maxima). Such a passage shares a shingle with the item, so item-sized
windows are laid where a shingle of the document is one of a benchmark item, in line with its place there. Windows get
a SimHash; eight blocks of eight bits index the items under every value within two bits, which finds all fingerprints
within RADIUS of each other; the exact similarity of shingles verifies them.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_RADIUS = 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Benchmark shingles up to which they are looked up in a set inside the scan; beyond, by a join.
SET_SHINGLES = 50_000
_SPACE = " \t\n\u000b\f\r"


def words(text: Column) -> Column:
    """Lower-cased words; an empty array for a text without any."""
    own = F.btrim(F.lower(text), F.lit(_SPACE))
    return F.when(F.coalesce(own, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(own, r"[\x20\x09-\x0D]+"))


def shingles(w: Column) -> Column:
    """Hashes of the shingles of a word array, in order; a shorter array is one shingle."""
    several = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < SHINGLE, F.array(F.xxhash64(w))).otherwise(several)


def simhash(hashes: Column) -> Column:
    """A bit is 1 where more than half of the hashes have it."""
    bit = lambda b: F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1)) * 2 > F.size(hashes)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda fp, b: F.when(bit(b), fp.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(fp))


def similarity(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of how often each hash occurs."""
    times = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, h: n + F.least(times(a, h), times(b, h)))
    return both / (F.size(a) + F.size(b) - both)


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)).cast("int")


def _near_values(fp: Column, i: int) -> Column:
    """(block, value) for every value within BLOCK_RADIUS bits of a fingerprint's block."""
    values = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda v: F.bit_count(v.bitwiseXOR(_block(fp, i))) <= BLOCK_RADIUS)
    return F.transform(values, lambda v: F.struct(F.lit(i).alias("block"), v.alias("value")))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, size (words), shingles and fp of each item with a word."""
    w = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string")).alias("w")).filter(F.size("w") > 0)
    return w.select("item_id", F.size("w").alias("size"), shingles(F.col("w")).alias("shingles")).withColumn("fp", simhash(F.col("shingles")))


def with_seeds(docs: DataFrame, places: DataFrame, set_shingles: int) -> DataFrame:
    """doc_id, rk, w, seeds (pos, h): documents that hold a benchmark shingle, and where."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = places.select("h").distinct()
    if wanted.count() <= set_shingles:
        known = [r["h"] for r in wanted.collect()]

        def found(w: Column) -> Column:
            at = let(shingles(w), lambda s: F.filter(F.transform(s, lambda h, i: F.when(h.isin(known), F.struct(i.alias("pos"), h.alias("h")))), lambda x: x.isNotNull()))
            return F.struct(w.alias("w"), (at if known else F.array()).cast("array<struct<pos:int,h:bigint>>").alias("seeds"))

        # The row number keeps the filter above the projection, which would else be computed twice.
        read = named.select("doc_id", F.xxhash64("text").alias("rk"), let(words(F.col("text")), found).alias("x"), F.monotonically_increasing_id().alias("row"))
        return read.filter(F.size("x.seeds") > 0).select("doc_id", "rk", "x.w", "x.seeds")
    named = named.select("doc_id", F.xxhash64("text").alias("rk"), words(F.col("text")).alias("w"))
    spread = named.select("doc_id", "rk", F.posexplode(let(F.col("w"), shingles)).alias("pos", "h")).join(wanted, "h")
    found = spread.groupBy("doc_id", "rk").agg(F.collect_list(F.struct("pos", "h")).alias("seeds")).withColumnsRenamed({"doc_id": "_d", "rk": "_r"})
    return named.join(found, named["doc_id"].eqNullSafe(found["_d"]) & (named["rk"] == found["_r"])).select("doc_id", "rk", "w", "seeds")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, set_shingles: int = SET_SHINGLES) -> DataFrame:
    """One row per document and item it copies: doc_id, item_id, start and n_words of the best window, similarity, rk.

    Of equally similar windows the first counts. Null and empty texts and items match nothing. A text shorter than an
    item is one window. Rows that repeat a doc_id and text count once; a null doc_id is reported as null. Empty tables
    give no rows; other columns are ignored. rk is the hash of the text, for telling rows of one doc_id apart.
    """
    items = staged(items_of(benchmark), "items")
    places = items.select("item_id", "size", F.posexplode("shingles").alias("at", "h"))
    seeded = staged(with_seeds(docs, places, set_shingles), "seeded").dropDuplicates(["doc_id", "rk"])
    seeds = seeded.select("doc_id", "rk", F.size("w").alias("total"), F.explode("seeds").alias("x")).select("doc_id", "rk", "total", "x.pos", "x.h")
    size = F.least("size", "total")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("total") - size))
    spots = seeds.join(places.select("size", "at", "h").distinct(), "h").select("doc_id", "rk", F.col("size").alias("size"), start.alias("start")).distinct()
    own = spots.groupBy("doc_id", "rk").agg(F.collect_list(F.struct("size", "start")).alias("spots")).withColumnsRenamed({"doc_id": "_d", "rk": "_r"})
    laid = seeded.join(own, seeded["doc_id"].eqNullSafe(own["_d"]) & (seeded["rk"] == own["_r"])).select("doc_id", "rk", "w", F.explode("spots").alias("x"))
    windows = laid.select("doc_id", "rk", "x.start", "x.size", F.slice("w", F.col("x.start") + 1, F.col("x.size")).alias("w"))
    windows = staged(windows.select("doc_id", "rk", "start", "size", F.size("w").alias("n_words"), let(F.col("w"), shingles).alias("ws"), F.monotonically_increasing_id().alias("row")).select("*", simhash(F.col("ws")).alias("fp")), "windows")
    index = items.select("item_id", "size", F.col("shingles").alias("its"), F.col("fp").alias("ifp")).withColumn("k", F.explode(F.flatten(F.array(*[_near_values(F.col("ifp"), i) for i in range(BLOCKS)]))))
    index = index.select("item_id", F.col("size").alias("isize"), "its", "ifp", F.col("k.block").alias("block"), F.col("k.value").alias("value"))
    probes = windows.withColumn("k", F.explode(F.array(*[F.struct(F.lit(i).alias("pblock"), _block(F.col("fp"), i).alias("pvalue")) for i in range(BLOCKS)]))).select("*", "k.*").drop("k")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS
    # Of the blocks in which the two agree, the first reports the pair.
    first = functools.reduce(lambda rest, i: F.when(F.bit_count(_block(F.col("fp"), i).bitwiseXOR(_block(F.col("ifp"), i))) <= BLOCK_RADIUS, F.lit(i)).otherwise(rest), reversed(range(BLOCKS)), F.lit(-1))
    met = probes.join(index, (F.col("size") == F.col("isize")) & (F.col("pblock") == F.col("block")) & (F.col("pvalue") == F.col("value")) & close & (F.col("pblock") == first))
    true = met.withColumn("similarity", similarity(F.col("ws"), F.col("its"))).filter(F.col("similarity") >= threshold)
    best = F.max_by(F.struct("start", "n_words", "similarity"), F.struct(F.col("similarity"), -F.col("start"))).alias("b")
    return true.groupBy("doc_id", "rk", "item_id").agg(best).select("doc_id", "item_id", "b.start", "b.n_words", "b.similarity", "rk")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """docs without those that hold a copy of a benchmark item; all columns stay as they are."""
    gone = contaminated(docs, benchmark, threshold).select(F.col("doc_id").alias("_d"), F.col("rk").alias("_r")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_d"]) & (F.xxhash64(docs["text"]) == gone["_r"]), "left_anti")
