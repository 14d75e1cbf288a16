"""Whole runs over a store: what is cached is taken from there, what is missing is enriched, look-ups by id, hash and job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, fingerprint, stripped
from ..operators import catalog, similarity
from ..sinks.store import Store
from ..sinks.writers import last_write, stored_columns, stored_rows
from .pipeline import enrich
from .shared import staged


def named(records: DataFrame) -> DataFrame:
    """Records with trimmed texts, those with a blank name left out."""
    trimmed = records.withColumns({c: stripped(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "description", "category") if c in records.columns})
    return trimmed.filter(F.col("name") != "")


def keyed(records: DataFrame, model: bool = False) -> DataFrame:
    """records with cache_key: the kind of run and the hash of the content."""
    return records.withColumn("cache_key", F.concat(F.lit("v1:llm:" if model else "v1:det:"), content_hash()))


def split_cached(records: DataFrame, cache: DataFrame, now: str = "current_timestamp()") -> tuple[DataFrame, DataFrame]:
    """Records whose content is cached and not expired, with the cached result, and those to compute.

    cache has cache_key, result and expires_at (null: never). Of several entries of a key the one that lasts longest counts.
    """
    live = cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.expr(now)))
    own = live.groupBy("cache_key").agg(F.max_by("result", F.coalesce("expires_at", F.lit("9999-12-31").cast("timestamp"))).alias("result"))
    return records.join(own, "cache_key"), records.join(own.select("cache_key"), "cache_key", "left_anti")


def missing_from_store(records: DataFrame, store: DataFrame) -> DataFrame:
    """Records whose fingerprint the store does not hold."""
    prints = records.withColumn("content_hash", fingerprint(F.col("name"), F.col("category")))
    return prints.join(store.select("content_hash"), "content_hash", "left_anti")


def enrich_batch(records: DataFrame, strict: bool = False) -> dict[str, DataFrame]:
    """products, summary, score, duplicates, outliers and conflicts of a catalogue. The chain runs once: products and narrow facts are staged."""
    products = staged(enrich(named(records), strict), "products")
    facts = staged(catalog.spec_facts(products).select("product_id", "code", "field", "num", "unit", "origin"), "facts")
    profiled = staged(catalog.profile(facts), "profile")
    source = products.select("product_id", "name", F.col("raw_category").alias("category"))
    return {
        "products": products, "summary": catalog.summary(products), "score": catalog.catalogue_score(source, facts, profiled=profiled),
        "duplicates": catalog.duplicate_groups(source), "outliers": catalog.outliers(facts, profiled=profiled), "conflicts": catalog.unit_conflicts(facts, source, profiled),
    }


def _document_rows(hits: DataFrame, job_id: str | None) -> DataFrame:
    """Rows for the store from cached results."""
    part = lambda path, kind: F.get_json_object("result", path).cast(kind)
    used = F.exists(F.map_values(F.from_json(F.get_json_object("result", "$.specifications"), "map<string,struct<origin:string>>")), lambda v: v["origin"] == "llm")
    return hits.select(
        "product_id", "content_hash", "name", "description", part("$.category.name", "string").alias("category"), "result", part("$.metrics.spec_count", "int").alias("spec_count"), part("$.validation.score", "double").alias("validation_score"),
        part("$.metrics.completeness", "double").alias("completeness"), F.coalesce(used, F.lit(False)).alias("llm_used"), F.lit(job_id).cast("string").alias("job_id"), F.current_timestamp().alias("created_at"),
    )


def _computed(enriched: DataFrame, job_id: str | None) -> DataFrame:
    """Rows for the store, with the cache key and what similarity compares: one pass over the chain."""
    whole = enriched.withColumn("_row", F.struct(*stored_columns(enriched.columns, job_id)))
    return similarity.vectors(whole, "_row", "cache_key").select("_row.*", "cache_key", "code", "specs", "content", "vector")


def run(records: DataFrame, store: Store, job_id: str | None = None, strict: bool = False, persist: bool = True, similar: bool = True, lasts: str | None = None) -> DataFrame:
    """Enriches records over a store: product_id, cache (hit or miss), persisted, result (JSON) and duplicates.

    Cached contents are not computed again; a cached record whose hash the store lacks is stored
    now, of several with one hash the one with the smallest id.
    Computed records are compared with the vectors that the store held before, then cached, stored and indexed. Every
    table of the store is read by its buckets. lasts is SQL of when what is cached now expires (none: never). Blank
    names are left out. The outcome is staged before anything is appended, so a run that fails half-way can be run again.
    """
    asked = keyed(named(records)).withColumn("content_hash", fingerprint(F.col("name"), F.col("category")))
    cached = staged(asked.join(store.cached(), "cache_key", "left").select(*asked.columns, "result"), "looked-up")
    hits = cached.filter("result IS NOT NULL")
    misses = cached.filter("result IS NULL").drop("result")
    fresh = staged(_computed(enrich(misses, strict), job_id), "computed")
    unstored = hits.join(store.hashes(), "content_hash", "left_anti")
    unstored = unstored.groupBy(F.col("content_hash").alias("_hash")).agg(F.min_by(F.struct(*unstored.columns), "product_id").alias("r")).select("r.*")
    late = staged(_document_rows(unstored, job_id), "late") if persist else None
    found = None
    if similar and not fresh.isEmpty():
        index = staged(store.index(), "index")
        pairs = similarity.duplicates(fresh.select("product_id", "name", "specs", "content", "vector"), index) if not index.isEmpty() else None
        found = staged(pairs.groupBy(F.col("query").alias("product_id")).agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("duplicates")), "found") if pairs is not None else None
    now = F.current_timestamp()
    store.append("cache", fresh.dropDuplicates(["cache_key"]).select("cache_key", "result", (F.expr(lasts) if lasts else F.lit(None)).cast("timestamp").alias("expires_at"), now.alias("created_at")))
    if persist:
        store.append("documents", fresh.select(*late.columns).unionByName(late))
        store.append("vectors", fresh)
    none = F.lit(None).cast("array<struct<place:int,id:bigint,score:double>>")
    missed = fresh.select("product_id", F.lit("miss").alias("cache"), F.lit(persist).alias("persisted"), "result")
    missed = missed.join(found, "product_id", "left") if found is not None else missed.withColumn("duplicates", none)
    kept = late.select("product_id", F.lit(True).alias("_kept")) if persist else None
    hit = hits.join(kept, "product_id", "left") if persist else hits.withColumn("_kept", F.lit(False))
    return missed.unionByName(hit.select("product_id", F.lit("hit").alias("cache"), F.coalesce("_kept", F.lit(False)).alias("persisted"), "result", none.alias("duplicates")))


def enrich_catalogue(records: DataFrame, store: Store | None = None, job_id: str | None = None, strict: bool = False) -> dict[str, DataFrame]:
    """enrich_batch, and its products in the store and its index."""
    batch = enrich_batch(records, strict)
    if store is not None:
        store.append("documents", stored_rows(batch["products"], job_id))
        store.append("vectors", similarity.vectors(batch["products"]).withColumn("created_at", F.current_timestamp()))
    return batch


def by_id(store: DataFrame, product_id) -> DataFrame:
    return store.filter(F.col("product_id") == product_id)


def latest_by_hash(store: DataFrame) -> DataFrame:
    """The newest row of each content hash."""
    return last_write(store, "content_hash", "created_at")


def recent(store: DataFrame, n: int = 20, order: str = "created_at") -> DataFrame:
    """The n newest rows, at most 200."""
    return store.orderBy(F.col(order).desc()).limit(max(1, min(n, 200)))


def of_job(store: DataFrame, jobs: DataFrame) -> DataFrame:
    """The rows that jobs have stored."""
    return store.join(jobs.select("job_id").distinct(), "job_id", "left_semi")
