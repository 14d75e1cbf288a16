"""A store in three tables of the session's catalogue, bucketed by the keys that runs look up, so that the store is never shuffled.

documents: every saved record, by content hash. cache: the result of each content, by cache key. vectors: what
similarity compares, by product. All are appended to; of rows with one key the newest counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "product_id long, content_hash string, name string, description string, category string, result string, spec_count int, validation_score double, completeness double, llm_used boolean, job_id string, created_at timestamp"
CACHE = "cache_key string, result string, expires_at timestamp, created_at timestamp"
VECTOR = "product_id long, name string, code string, specs map<string,struct<num:double,unit:string>>, content string, vector array<double>, created_at timestamp"
TABLES = {"documents": (DOCUMENT, "content_hash"), "cache": (CACHE, "cache_key"), "vectors": (VECTOR, "product_id")}


@dataclass(frozen=True)
class Store:
    """name begins the names of its tables; folder holds their files (none: the warehouse)."""

    spark: SparkSession
    name: str
    folder: str | None = None
    buckets: int = 32

    def table(self, which: str) -> DataFrame:
        if not self.spark.catalog.tableExists(f"{self.name}_{which}"):
            self.append(which, self.spark.createDataFrame([], TABLES[which][0]))
        return self.spark.table(f"{self.name}_{which}")

    def append(self, which: str, rows: DataFrame) -> None:
        """Rows are dealt by the bucket key, parts that come out too large are split: then a bucket gets several files."""
        schema, key = TABLES[which]
        columns = [c.split()[0] for c in schema.split(", ")]
        typed = rows.select(*columns).hint("rebalance", key)
        writer = typed.write.mode("append").bucketBy(self.buckets, key).sortBy(key)
        (writer.option("path", f"{self.folder}/{which}") if self.folder else writer).saveAsTable(f"{self.name}_{which}")

    def cached(self, now: str = "current_timestamp()") -> DataFrame:
        """cache_key and result of what has not expired; of several results the one that lasts longest."""
        live = self.table("cache").filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.expr(now)))
        return live.groupBy("cache_key").agg(F.max_by("result", F.coalesce("expires_at", F.lit("9999-12-31").cast("timestamp"))).alias("result"))

    def hashes(self) -> DataFrame:
        return self.table("documents").select("content_hash")

    def index(self) -> DataFrame:
        """The newest vector of each product."""
        columns = ["name", "code", "specs", "content", "vector"]
        newest = self.table("vectors").groupBy("product_id").agg(F.max_by(F.struct(*columns), "created_at").alias("v"))
        return newest.select("product_id", "v.*")
