"""The per-record pipeline: extract, classify, derive, describe, validate. One chain of projections, no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import keywords_sql, text_blob
from ..operators.classify import classify
from ..operators.derive import derive, describe
from ..operators.extract import extract, listed
from ..operators.validate import validate


def with_text(raw: DataFrame) -> DataFrame:
    """raw has product_id, name, description, category and attributes; the source's category becomes raw_category."""
    named = raw.withColumnRenamed("category", "raw_category")
    return named.selectExpr("*", f"{text_blob()} AS text")


def read(raw: DataFrame) -> DataFrame:
    """Records with what their text and attributes say: given, t, s, specs and keywords."""
    return extract(with_text(raw)).selectExpr("*", f"{listed()} AS specs", f"{keywords_sql('text')} AS keywords")


def enrich(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Every record with specs, category, findings and scores. Classification comes before derivation.

    Null names, descriptions, categories and attributes are allowed: such a record comes out with findings, never with
    an error. An empty table stays empty.

    The number of records is observed as the rows pass. A filter does not move below an observation,
    so that what is asked of the result (an explode, a join) is never unfolded into the whole chain; columns that nobody
    reads are still left out.
    """
    found = validate(describe(derive(classify(read(raw)))), strict)
    return found.observe(f"enriched-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("records"))
