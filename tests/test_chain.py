"""What the chain finds by its cheaper tests, and how it is dealt."""

from specforge.functions.sql import general, strip
from specforge.operators.extract import extract, firsts, needles
from specforge.plans.pipeline import enrich, with_text
from specforge.sources import catalog


def raw(spark, rows):
    return spark.createDataFrame(rows, "product_id long, name string, description string, category string, attributes map<string,string>")


def test_matches_in_texts_of_any_script(spark):
    texts = {1: "flow rate: 40 m3/h, 415 V", 2: "flow rate: \u0664\u0660 m3/h, 415\u00a0V", 3: "a\u0001b 5.5 kW pump, DN50", 4: "\u0001\u0001 IP 65, 90 \u00b0C", 5: "415\n V", 6: "4 valves, 5 wheels"}
    got = {r["product_id"]: r for r in extract(with_text(raw(spark, [(i, t, "", None, None) for i, t in texts.items()]))).select("product_id", "t.*", "text").collect()}
    assert got[1]["flow_rate"]["num"] == 40.0 and got[1]["voltage"]["num"] == 415.0 and got[2]["voltage"]["num"] == 415.0
    assert got[3]["power"]["num"] == 5500.0 and got[3]["nominal_bore"]["str"] == "DN50" and got[3]["power"]["raw"] == "5.5 kW"
    assert got[4]["ip_rating"]["str"] == "IP65" and got[4]["max_temperature"]["num"] == 90.0 and got[5]["voltage"]["num"] == 415.0
    assert got[6]["voltage"] is None and got[6]["power"] is None
    for i, f in ((1, "voltage"), (3, "power"), (4, "ip_rating")):
        v = got[i][f]
        assert got[i]["text"][v["start"] : v["stop"]].strip() == v["raw"]


def test_parts_grow_with_the_records(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "part"))
    monkeypatch.setattr(catalog, "PART", 50)
    assert catalog.spread(spark.read.parquet(str(tmp_path / "part"))).rdd.getNumPartitions() == 20


def test_leaves_keep_their_scores(spark):
    """Leaves without a term in the texts still score by their typical fields."""
    (r,) = enrich(raw(spark, [(1, "thing", "40 m3/h at 3 bar, 4 kW", None, None)])).select("ranked").collect()
    assert r["ranked"] and all(x["score"] > 0 and not [m for m in x["matched"] if not m.startswith("specs:")] for x in r["ranked"])


def test_what_nobody_asks_for_is_not_weighed(spark):
    """Who reads the category alone does not pay for the ranking's terms, nor for the other columns of the chain."""
    plan = enrich(raw(spark, [(1, "ball valve", "DN50", None, None)])).select("product_id", "category.code")._jdf.queryExecution().optimizedPlan().toString()
    assert "penalised" not in plan and "_single" not in plan


def test_a_plain_text_rules_branches_out():
    """In a text of ASCII alone a branch that needs another character cannot match, and a match begins with few characters."""
    assert needles(r"(?:diameter|dia\.?|bore|ø)\s*(\d+)", plain=True) == ["bore", "dia", "diameter"]
    assert needles(r"(\d+)\s*(°C|°F)\b", plain=True) is None and needles(r"(\d+)\s*(°C|°F)\b") == ["c", "f"]
    assert firsts(r"\b(?:rated\s+)?(?:power|output)\s*(\d+)") == r"(?=[\x6f\x70\x72])"
    assert firsts(r"\b(S[1-9])") == r"(?=[\x53])" and firsts(r"\s*") == firsts(r"[^a]b") == ""


def test_blanks_and_numbers_as_before(spark):
    """Cutting blanks off does what the pattern did for every character; whole numbers are told like the others."""
    x = spark.range(1, 55296).selectExpr("concat(char(1), decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE'), ' a b ', decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')) AS y").selectExpr("y", "substring(y, 2) AS x")
    assert x.filter(f"{strip('x')} <> regexp_replace(x, r'(?U)^\\s+|\\s+$', '')").count() == 0
    v = spark.createDataFrame([(x,) for x in (0.0, -0.0, 7.0, -40.0, 999999.0, 1e6, 1234567.0, 2.5, -0.25, 1e-5, 100000.25)], "v double")
    assert [r[0] for r in v.selectExpr(general("v")).collect()] == ["0", "0", "7", "-40", "999999", "1e+06", "1.23457e+06", "2.5", "-0.25", "1e-05", "100000"]
