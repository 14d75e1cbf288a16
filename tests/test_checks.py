"""Exact percentiles by selection, and catalogue checks read from one profile."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from specforge.operators import catalog, evaluate


def plain(rows, points=(0.5, 0.95, 0.99)):
    out = {}
    for key in {k for k, _ in rows}:
        own = sorted(v for k, v in rows if k == key and v is not None)
        if own:
            out[key] = (len(own), *(own[min(math.floor(len(own) * p), len(own) - 1)] for p in points))
    return out


@pytest.mark.parametrize("within", [1, 40, 100_000])
def test_percentiles_are_exact_however_often_they_are_bracketed(spark, within):
    rnd = random.Random(2)
    rows = [("even", rnd.random()) for _ in range(3000)] + [("hot", 0.0 if rnd.random() < 0.7 else rnd.gauss(0, 1e6)) for _ in range(3000)] + [("wild", 10.0 ** rnd.randint(-300, 300)) for _ in range(500)]
    rows += [(None, float(i)) for i in range(7)] + [("one", 5.0), ("null", None), ("even", None)]
    got = evaluate.percentiles(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], within=within).collect()
    assert {r["k"]: (r["n"], r["p50"], r["p95"], r["p99"]) for r in got} == plain(rows)


def test_percentiles_without_groups_and_of_nothing(spark):
    df = spark.range(1001).select(F.col("id").alias("v"))
    assert tuple(evaluate.percentiles(df, "v", within=10).first())[:1] + tuple(evaluate.percentiles(df, "v", within=10).first())[2:] == (1001, 500, 950, 990)
    assert evaluate.percentiles(df.limit(0), "v", []).collect() in ([], [(0, None, None, None, None)])


def test_moments_merge_over_units_and_origins(spark):
    rnd = random.Random(3)
    rows = [(i, "A", rnd.choice(["p", "q"]), rnd.gauss(1e6, 3), rnd.choice(["W", "kg", None]), rnd.choice(["input", "extracted"])) for i in range(400)]
    facts = spark.createDataFrame([*rows, (999, "A", "p", None, None, "input")], "product_id long, code string, field string, num double, unit string, origin string")
    got = {r["field"]: r for r in catalog.moments(catalog.profile(facts)).collect()}
    for f in ("p", "q"):
        own = [r[3] for r in rows if r[2] == f]
        assert got[f]["n"] == len(own)
        assert got[f]["mean"] == pytest.approx(statistics.fmean(own)) and got[f]["deviation"] == pytest.approx(statistics.pstdev(own), rel=1e-6)


def test_a_large_group_of_duplicates_keeps_its_count(spark):
    records = spark.range(50).select(F.col("id").alias("product_id"), F.lit("Pump A").alias("name"), F.lit("x").alias("category"))
    (g,) = catalog.duplicate_groups(records, most=3).collect()
    assert g["n"] == 50 and g["names"] == ["Pump A"] * 3
    assert [r["product_id"] for r in catalog.duplicate_members(records).orderBy("place").collect()] == list(range(50))
