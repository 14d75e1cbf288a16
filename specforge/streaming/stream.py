"""Catalogue runs in bounded memory: files arrive, micro-batches are enriched, stored and counted."""

from __future__ import annotations

import threading

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.window import Window

from ..functions.text import content_hash
from ..plans.pipeline import enrich
from ..sinks.writers import JOB, job_row, stored_rows

#: The name of the observation that counts what a batch stores.
STORED = "stored"

RAW = "product_id long, name string, description string, category string, source string, source_ref string, attributes map<string,string>"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Raw records from Parquet files as they arrive; blank names are dropped."""
    rows = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.filter(F.trim(F.coalesce("name", F.lit(""))) != "")


class JobRows(StreamingQueryListener):
    """Job rows from the progress of a query: no one reads the store to count it.

    Each batch says how many records it stored; the total goes on from the job's last row, so that a restarted run
    counts on. A batch that is run again has the same number, and its later row counts.
    """

    def __init__(self, spark: SparkSession, jobs: str, job_id: str):
        self.spark, self.jobs, self.job_id, self.id = spark, jobs, job_id, None
        self.ended = threading.Event()
        self.totals = {r["seq"]: r["processed"] for r in job_rows(spark, jobs).filter((F.col("job_id") == job_id) & (F.col("status") == "running")).select("seq", "processed").collect()}

    @property
    def total(self) -> int:
        return self.totals[max(self.totals)] if self.totals else 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.id = event.id

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(STORED)
        if event.progress.id == self.id and seen is not None and seen["n"] is not None and event.progress.numInputRows:
            number = event.progress.batchId
            before = max((v for k, v in self.totals.items() if k < number), default=0)
            self.totals[number] = before + seen["n"]
            job_row(self.spark, self.job_id, "running", 0, self.totals[number], number).write.mode("append").parquet(self.jobs)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.id == self.id:
            self.ended.set()


def job_rows(spark: SparkSession, jobs: str) -> DataFrame:
    """The rows of a jobs table; none before the first."""
    try:
        return spark.read.schema(JOB).parquet(jobs)
    except AnalysisException:
        return spark.createDataFrame([], JOB)


def start(spark: SparkSession, source: str, store: str, checkpoint: str, job_id: str, files_per_batch: int = 16) -> StreamingQuery:
    """Enriches what lies in source and ends. Each batch is a part of the store, replaced if the batch is run again.

    The contents met so far are a keyed state of the query: a record whose name, description and attributes came before,
    in this batch, another or before a restart, is not stored twice.
    """

    def keep(batch: DataFrame, number: int) -> None:
        rows = stored_rows(enrich(batch.drop("_content")), job_id).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)

    new = read_stream(spark, source, files_per_batch).withColumn("_content", content_hash()).dropDuplicates(["_content"]).observe(STORED, F.count(F.lit(1)).alias("n"))
    return new.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run(spark: SparkSession, source: str, store: str, jobs: str, checkpoint: str, job_id: str, files_per_batch: int = 16) -> int:
    """start(), waited for; job rows are written as batches end, the last one done or failed. Returns the number of records stored."""
    listener, last = JobRows(spark, jobs, job_id), 2**62
    job_row(spark, job_id, "queued", 0, listener.total, -1).write.mode("append").parquet(jobs)
    spark.streams.addListener(listener)
    try:
        start(spark, source, store, checkpoint, job_id, files_per_batch).awaitTermination()
        listener.ended.wait(60)
    except Exception:
        job_row(spark, job_id, "failed", 0, listener.total, last).write.mode("append").parquet(jobs)
        raise
    finally:
        spark.streams.removeListener(listener)
    job_row(spark, job_id, "done", listener.total, listener.total, last).write.mode("append").parquet(jobs)
    return listener.total


def chunks(records: DataFrame, size: int = 500, order: str = "product_id") -> DataFrame:
    """records with chunk, its offset and count. Numbers come from the counts of range partitions, so no row is sorted alone."""
    ranged = records.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id())
    marked = ranged.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    parts = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    first = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    at = (F.col("_first") + F.col("_at")).alias("_row")
    placed = marked.join(F.broadcast(first), "_part").select(*records.columns, at, "_total")
    offset = F.floor(F.col("_row") / size) * size
    return placed.select(*records.columns, F.floor(F.col("_row") / size).cast("long").alias("chunk"), offset.cast("long").alias("offset"), F.least(F.lit(size), F.col("_total") - offset).cast("long").alias("count"))
