import pytest
from compare import same
from pyspark.sql import functions as F

from specforge.functions.text import is_heading, normalise_key
from specforge.functions.units import convert, values_agree
from specforge.plans.pipeline import enrich
from specforge.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, queries()[name], oracle_sql()[name], SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(queries()) <= set(e.queries())


def test_units(spark):
    one = spark.range(1)
    got = one.select(convert(F.lit(10.0), F.lit("HP"), F.lit("kW")).alias("a"), convert(F.lit(212.0), F.lit("°F"), F.lit("C")).alias("b"), convert(F.lit(1.0), F.lit("kg"), F.lit("bar")).alias("c"), values_agree(F.lit(11.0), F.lit("kW"), F.lit(11050.0), F.lit("W")).alias("d")).first()
    assert got["a"] == pytest.approx(7.45699872) and got["b"] == pytest.approx(100.0) and got["c"] is None and got["d"]


def test_text_helpers(spark):
    assert spark.range(1).select(normalise_key(F.lit(" Rated Power ")).alias("k")).first()["k"] == "power"


@pytest.mark.parametrize(("line", "expected"), [("2.1. Motors", True), ("2) Motors", True), ("CENTRIFUGAL PUMPS", True), ("2.1 Motors", False), ("a plain sentence.", False), ("ABC", False), ("PUMPS:", False)])
def test_is_heading(spark, line, expected):
    """A number counts only with a dot or bracket after it: `2.1 Motors` is none."""
    assert spark.range(1).select(is_heading(F.lit(line)).alias("h")).first()["h"] is expected


def test_nulls_and_an_empty_catalogue(spark):
    kind = "product_id long, name string, description string, category string, attributes map<string,string>"
    got = enrich(spark.createDataFrame([(1, None, None, None, None), (2, "", "", "", {})], kind)).select("product_id", "category.code", "validation.is_valid").collect()
    assert [(r["code"], r["is_valid"]) for r in sorted(got)] == [("GEN.UNK", False)] * 2
    assert enrich(spark.createDataFrame([], kind)).count() == 0
