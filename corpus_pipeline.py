"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specforge.llm import decontam, langid, linededup, packing, simhash
from specforge.llm.common import fold, staged, table, unused

LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those whose language the model doubts.

    Repeated rows fare alike, very long texts are read whole, an empty table stays empty, all columns are kept.
    """
    model = langid.train(docs, fold(F.col("doc_id"), 3) != 1)
    (found,) = unused(docs.columns, "language")
    seen = docs.withColumn(found, langid.predictor(model)(F.col("text").cast("string")))
    return seen.filter((F.col(f"{found}.lang_pred") != langid.UNKNOWN) & (F.col(f"{found}.score") >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that stood earlier in the corpus; a document that has nothing left but lost lines goes.

    Null texts and rows without an id stay as they are; of equal lines the first by doc_id and place stays. An empty
    table stays empty, very long texts lose lines like any, all columns are kept, n_chars follows the text.
    """
    names = unused(docs.columns, "n_removed_before", "n_lines_before", "n_near_before")
    clash = {c: new for c, new in zip(("n_removed", "n_lines", "n_near"), names, strict=True) if c in docs.columns}
    cleaned = linededup.deduplicate(docs.withColumnsRenamed(clash))
    kept = cleaned.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, as simhash.keep_one says."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy of a benchmark item; null and empty texts stay, repeated rows fare alike.

    An empty table stays empty, an empty benchmark drops nothing, all columns are kept.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null or empty text is its end id, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", benchmark), ("packing", packed)]

#: Language ID, SimHash and tokenizers cannot be written as SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, name)
    return docs
