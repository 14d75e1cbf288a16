"""Findings that the catalogue never fires, and small functions of the interface, with values written out."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from specforge.functions.embedding import cosine
from specforge.operators import proposals, similarity
from specforge.operators.validate import validate
from specforge.plans import service
from specforge.plans.pipeline import enrich

KIND = "product_id long, name string, description string, category string, attributes map<string,string>"
AGAIN = ("findings", "validation", "completeness", "mean_confidence")


def enriched(spark, *rows):
    return enrich(spark.createDataFrame([(i, n, d, c, a) for i, (n, d, c, a) in enumerate(rows)], KIND))


def rules(df):
    return {r["product_id"]: {(f["rule"], f["severity"]) for f in r["findings"]} for r in df.select("product_id", "findings").collect()}


def test_an_unknown_kind_of_product_has_a_weak_category(spark):
    got = rules(enriched(spark, ("Zzyx qwv", "nothing known", None, None), ("Ball valve DN50", "", None, None)))
    assert ("VAL.ID.WEAK_CATEGORY", "minor") in got[0] and ("VAL.ID.WEAK_CATEGORY", "minor") not in got[1]


def test_a_record_without_category(spark):
    df = enriched(spark, ("Ball valve DN50", "", None, None)).drop(*AGAIN)
    got = rules(validate(df.withColumn("category", F.lit(None).cast(df.schema["category"].dataType))))
    assert ("VAL.ID.NO_CATEGORY", "major") in got[0]


def test_values_of_little_confidence(spark):
    df = enriched(spark, ("Induction motor 4 kW 400 V", "", None, None)).drop(*AGAIN)
    doubtful = df.withColumn("specs", F.transform("specs", lambda v: v.withField("confidence", F.lit(0.3))))
    assert ("VAL.CONF.LOW", "minor") in rules(validate(doubtful))[0] and ("VAL.CONF.LOW", "minor") not in rules(validate(df))[0]


def test_an_ip_rating_becomes_an_attribute(spark):
    got = enriched(spark, ("Induction motor", "IP65 4 kW", None, None), ("Induction motor", "IP54 4 kW", None, None)).select("product_id", "extra_attributes").collect()
    assert {r["product_id"]: r["extra_attributes"] for r in got} == {0: ["Suitable for washdown environments"], 1: []}


def test_replies_bring_attributes_descriptions_and_categories(spark):
    e = enriched(spark, ("Zzyx qwv", "nothing known", None, None))
    told = "This is a ball valve for water and steam, as the maker says."
    reply = '{"attributes": ["quarter turn", "abc", "  long enough  "], "description": "' + told + '", "category_suggestion": "vlv.ball"}'
    m = proposals.merge(e, spark.createDataFrame([(0, reply)], "product_id long, reply string")).first()
    assert {"quarter turn", "long enough"} <= set(m["extra_attributes"]) and "abc" not in m["extra_attributes"]
    assert m["enriched_description"] == told and m["alternatives"][0]["code"] == "VLV.BALL"


def test_a_merged_record_can_be_described_again(spark):
    e = enriched(spark, ("Ball valve DN50", "", None, None)).withColumn("enriched_description", F.lit(None).cast("string"))
    m = proposals.merge(e, spark.createDataFrame([], "product_id long, reply string"))
    assert proposals.redescribe(m).first()["enriched_description"].startswith("Ball valve DN50 is a ball valve")


def test_cosine_and_point_ids(spark):
    rows = [([1.0, 2.0], [2.0, 4.0], 1.0), ([1.0, 0.0], [0.0, 3.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([3.0, 4.0], [4.0, 3.0], 0.96)]
    got = spark.createDataFrame([(a, b) for a, b, _ in rows], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r["c"] for r in got] == pytest.approx([w for *_, w in rows])
    ids = spark.createDataFrame([("p-1",), ("ü",)], "x string").select("x", similarity.point_id(F.col("x")).alias("i")).collect()
    assert all(r["i"] == int.from_bytes(hashlib.sha1(r["x"].encode()).digest()[:8], "big") >> 1 for r in ids) and math.log2(max(r["i"] for r in ids)) < 63


def test_point_look_ups(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1)], "product_id long, content_hash string, created_at int")
    assert service.by_id(rows, 2).first()["content_hash"] == "a"
    assert {r["content_hash"]: r["product_id"] for r in service.latest_by_hash(rows).collect()} == {"a": 2, "b": 3}
