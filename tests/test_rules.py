"""Every extraction rule, unit, leaf and finding against values written out here, apart from the library's tables."""

import pytest
from pyspark.sql import functions as F

from specforge.functions.units import convert, resolve, to_canonical
from specforge.operators import evaluate, explain, proposals, similarity
from specforge.plans.pipeline import enrich
from specforge.sinks import writers
from specforge.streaming import stream

KIND = "product_id long, name string, description string, category string, source string, source_ref string, attributes map<string,string>"
RULES = [
    ("rated power: 2.2 kW", "power", 2200.0, "EXT.POWER.LABELLED"), ("750 W rated output", "power", 750.0, "EXT.POWER.TRAILING"), ("3 HP pump", "power", 2237.099616, "EXT.POWER.BARE"), ("draws 60 W now", "power", 60.0, "EXT.POWER.BARE_W"),
    ("supply 415 V", "voltage", 415.0, "EXT.VOLTAGE.LABELLED"), ("for 11 kV lines", "voltage", 11000.0, "EXT.VOLTAGE.BARE"), ("current: 63 A", "current", 63.0, "EXT.CURRENT.LABELLED"), ("20 mA output", "current", 0.02, "EXT.CURRENT.TRAILING"), ("a 9 A fuse", "current", 9.0, "EXT.CURRENT.BARE"),
    ("50 Hz", "frequency", 50.0, "EXT.FREQUENCY"), ("three phase", "phase", "3-phase", "EXT.PHASE"), ("single-phase", "phase", "1-phase", "EXT.PHASE"), ("speed 1,440 rpm", "rotational_speed", 1440.0, "EXT.SPEED"), ("torque 350 Nm", "torque", 350.0, "EXT.TORQUE"), ("about 40 N-m", "torque", 40.0, "EXT.TORQUE.BARE"),
    ("weight -5 kg", "weight", -5.0, "EXT.WEIGHT"), ("a 450 g part", "weight", 0.45, "EXT.WEIGHT.BARE"), ("working pressure up to 16 bar", "pressure", 16.0, "EXT.PRESSURE"), ("100 psi", "pressure", 6.89476, "EXT.PRESSURE.BARE"), ("flow rate 40 m3/h", "flow_rate", 40.0, "EXT.FLOW"), ("100 LPM", "flow_rate", 6.0, "EXT.FLOW.BARE"),
    ("max temp 212 F", "max_temperature", 100.0, "EXT.TEMPERATURE"), ("to 80°C", "max_temperature", 80.0, "EXT.TEMPERATURE.BARE"), ("noise level 72 dBA", "noise_level", 72.0, "EXT.NOISE"), ("DN50", "nominal_bore", "DN50", "EXT.BORE.DN"), ("length 2 m", "length", 2000.0, "EXT.LENGTH.LABELLED"), ("bore 1 in", "diameter", 25.4, "EXT.DIAMETER"),
    ("height 3 ft", "height", 914.4, "EXT.HEIGHT"), ("wide 5 cm", "width", 50.0, "EXT.WIDTH"), ("tank 500 L", "volume", 500.0, "EXT.VOLUME"), ("holds 250 ml", "volume", 0.25, "EXT.VOLUME.BARE"), ("IP 67", "ip_rating", "IP67", "EXT.IP_RATING"), ("insulation class F", "insulation_class", "F", "EXT.INSULATION_CLASS"), ("ie3", "efficiency_class", "IE3", "EXT.EFFICIENCY_CLASS"),
    ("flange mounted", "mounting", "Flange Mounted", "EXT.MOUNTING"), ("S1 duty", "duty_cycle", "S1", "EXT.DUTY_CYCLE"), ("flame proof", "protection_class", "FLAME PROOF", "EXT.PROTECTION"), ("M20x1.5", "thread_size", "M20x1.5", "EXT.THREAD"), ("efficiency: 92 %", "efficiency", "92", "EXT.EFFICIENCY_PCT"),
    ("body of ss 316", "material", "Stainless Steel 316", "EXT.MATERIAL.VOCAB"), ("1 kg", "weight", 1.0, "EXT.WEIGHT.BARE"),
]
NOTHING = [("frame 100L", "volume"), ("frame size: 112L", "volume"), ("16-bar", "pressure"), ("5 liters", "volume"), ("weight 5 V", "weight"), ("m20", "thread_size"), ("60 W-class", "power")]


def records(spark, rows):
    return spark.createDataFrame([(i, n, d, c, "t", f"r{i}", a) for i, (n, d, c, a) in enumerate(rows)], KIND)


def test_rules(spark):
    got = {r["product_id"]: r["s"] for r in enrich(records(spark, [(None, t, None, None) for t, *_ in RULES])).select("product_id", "s").collect()}
    for i, (text, field, value, rule) in enumerate(RULES):
        v = got[i][field]
        assert v is not None and v["rule"] == rule and (v["num"] == pytest.approx(value) if isinstance(value, float) else v["str"] == value), (text, v)


def test_texts_without_a_value(spark):
    got = {r["product_id"]: r["s"] for r in enrich(records(spark, [(None, t, None, None) for t, _ in NOTHING])).select("product_id", "s").collect()}
    for i, (text, field) in enumerate(NOTHING):
        assert got[i][field] is None, text


def test_spans_snippets_and_overrides(spark):
    e = enrich(records(spark, [("Motor", "a 5.5 kW motor of our own", None, {"Rated Power": "\t2.2 kW\n", "net weight": "28", "Colour": " red "})]))
    s = {r["field"]: r for r in explain.field_provenance(e).collect()}
    assert (s["power"]["num"], s["power"]["origin"], s["power"]["display"]) == (2200.0, "input", "2200 W")
    assert [x["rule"] for x in s["power"]["evidence"]] == ["EXT.ATTR.STRUCTURED", "MERGE.TRUST_ORDER"] and "2200 W" in s["power"]["evidence"][1]["detail"]
    assert s["weight"]["num"] == 28.0 and s["weight"]["unit"] is None and s["colour"]["display"] == "red"
    (r,) = enrich(records(spark, [("Motor", "runs at 415 V supply", None, None)])).select("text", "s.voltage").collect()
    v = r["voltage"]
    assert r["text"][v["start"] : v["stop"]] == "415 V" == v["raw"]


@pytest.mark.parametrize(("value", "source", "target", "want"), [(3.0, "HP", "W", 2237.099616), (1.0, "m3", "L", 1000.0), (212.0, "°F", "C", 100.0), (0.0, "K", "C", -273.15), (1.0, "kgf/cm2", "bar", 0.980665), (1.0, "CFM", "m³/h", 1.699011), (2.0, "ft", "mm", 609.6), (1.0, "lbft", "Nm", 1.355818), (1.0, "tonne", "kg", 1000.0), (1.0, "kg", "bar", None), (1.0, "parsec", "m", None)])
def test_conversion(spark, value, source, target, want):
    got = spark.range(1).select(convert(F.lit(value), F.lit(source), F.lit(target)).alias("x"), to_canonical(F.lit(value), resolve(F.lit(source))).alias("y")).first()
    assert got["x"] == (None if want is None else pytest.approx(want))


FINDINGS = [
    (("", "x", None, None), "VAL.ID.NAME_MISSING"), (("P7", "x", None, None), "VAL.ID.NAME_SHORT"), (("thing", "x", None, None), "VAL.ID.WEAK_CATEGORY"), (("induction motor", "415 V", None, None), "VAL.REQ.POWER"), (("induction motor", "", None, None), "VAL.REQ.EXPECTED_GAPS"),
    (("motor", "weight -5 kg", None, None), "VAL.RANGE.NEGATIVE.WEIGHT"), (("motor", "", None, {"bogus": "-4"}), "VAL.RANGE.NEGATIVE.BOGUS"), (("induction motor", "power 5 W", None, None), "VAL.RANGE.POWER"), (("thing", "415 V supply, supply 300 V", None, {"voltage": "300 V"}), "VAL.RANGE.NONSTANDARD_VOLTAGE"),
    (("motor", "9 kW, 230 V, 10 A", None, None), "VAL.COH.POWER_TOO_HIGH"), (("motor", "100 W motor, 230 V, 10 A", None, None), "VAL.COH.POWER_TOO_LOW"), (("motor", "50 Hz, 2200 rpm", None, None), "VAL.COH.SPEED_VS_FREQ"), (("motor", "1 kW, 1500 rpm, torque 50 Nm", None, None), "VAL.COH.POWER_TORQUE_SPEED"),
    (("roll", "diameter 10 mm, width 100 mm", None, None), "VAL.COH.ASPECT_RATIO"), (("box", "length 10 mm, width 10 mm, height 10 mm, weight 5 kg", None, None), "VAL.COH.DENSITY"),
]


def test_findings(spark):
    got = {r["product_id"]: [f["rule"] for f in r["findings"]] for r in enrich(records(spark, [r for r, _ in FINDINGS])).select("product_id", "findings").collect()}
    for i, (row, rule) in enumerate(FINDINGS):
        assert rule in got[i], (row, got[i])


def test_unit_slip_strict_and_scores(spark):
    rows = records(spark, [("induction motor", "power 5 W, 415 V, 1440 rpm", None, None), ("safety helmet", "ce", None, None)])
    found = {f["rule"]: f for r in enrich(rows).filter("product_id = 0").collect() for f in r["findings"]}
    assert found["VAL.RANGE.POWER"]["suggestion"] == "x1000" and found["VAL.RANGE.POWER"]["severity"] == "major"
    plain, strict = (enrich(rows, s).filter("product_id = 1").first()["validation"] for s in (False, True))
    assert plain["is_valid"] and not strict["is_valid"] and plain["score"] == 0.94


def test_classification(spark):
    cases = [("Centrifugal pump CP-200", "", "PMP.CENT"), ("pumpkin slicer", "", "GEN.UNK"), ("Gear motor", "servo motor with encoder", "MOT.SRV"), ("x", "circuit breaker 63 A", "ELC.SWG"), ("Dosing pump", "diaphragm pump", "PMP.POS")]
    got = {r["product_id"]: r["code"] for r in enrich(records(spark, [(n, d, None, None) for n, d, _ in cases])).select("product_id", "category.code").collect()}
    assert got == {i: c for i, (*_, c) in enumerate(cases)}


def test_proposals_never_outrank_the_source(spark):
    e = enrich(records(spark, [("induction motor", "2.2 kW", None, None), ("induction motor", "2.2 kW", None, None), ("thing", "", None, None)]))
    lie = '```json\n{"specifications": {"power": {"value": 9, "unit": "kW"}, "volts": {"value": 415, "unit": "V", "basis": "usual"}, "speed": {"value": 3, "unit": "lightyear"}, "mood": 1, "material": "brass"}, "attributes": ["ok", "long enough"], "description": "A motor that is described in more than thirty characters."}\n```'
    replies = spark.createDataFrame([(0, lie), (1, "no json at all"), (2, 'Sure! {"specifications": {}, "category_suggestion": "ball valve"} bye {')], "product_id long, reply string")
    got = {r["product_id"]: r for r in proposals.merge(e, replies).collect()}
    assert got[0]["s"]["power"]["num"] == 2200.0 and got[0]["s"]["voltage"]["num"] == 415.0 and got[0]["s"]["voltage"]["origin"] == "llm" and got[0]["s"]["material"]["str"] == "brass"
    assert got[0]["accepted"] == ["voltage", "material"] and {(x["key"], x["reason"]) for x in got[0]["rejected"]} == {("power", "known from the source"), ("speed", "unknown unit"), ("mood", "not in the schema")}
    assert got[0]["extra_attributes"] == ["long enough"] and got[0]["enriched_description"].startswith("A motor that")
    assert got[1]["accepted"] == [] and got[2]["alternatives"][0]["code"] == "VLV.BALL"


def test_a_client_that_fails_leaves_gaps(spark):
    def client(prompts):
        raise TimeoutError

    e = enrich(records(spark, [("induction motor", "2.2 kW", None, None)]))
    assert [r["reply"] for r in proposals.ask(proposals.prompts(e), client).collect()] == [None]
    assert "voltage" in proposals.prompts(e).first()["prompt"]


def test_values_match(spark):
    kind = "expected string, v struct<num:double,str:string,list:array<string>>"
    rows = [("3 HP", (2237.0, None, None), True), ("3 HP", (1500.0, None, None), False), ("IP55", (None, "ip55", None), True), ('["CE", "ul"]', (None, None, ["CE", "UL", "CSA"]), True), ('["CE"]', (None, None, ["UL"]), False), ("CE", (None, None, ["UL", "CE"]), True), ("7", (7.2, None, None), True), ("2 kW", (None, "2 kW", None), False)]
    got = spark.createDataFrame([(e, v) for e, v, _ in rows], kind).selectExpr(f"{evaluate.values_match('expected', 'v')} AS m").collect()
    assert [r["m"] for r in got] == [w for *_, w in rows]


def test_duplicates_are_confirmed_by_measurements(spark):
    names = [("Motor 11 kW 415 V three phase foot mounted induction", ""), ("Motor 11 kW  415V three-phase foot mounted induction", ""), ("Motor 18.5 kW 415 V three phase foot mounted induction", ""), ("steel bolt", "M20")]
    v = similarity.vectors(enrich(records(spark, [(n, d, None, None) for n, d in names])))
    got = {(r["query"], r["id"]): r["conflict"] for r in similarity.candidates(v, v).collect()}
    assert got[(0, 1)] is None and got[(0, 2)] is not None and (0, 3) not in got
    assert {(r["query"], r["id"]) for r in similarity.duplicates(v, v).collect()} == {(0, 1), (1, 0)}


def test_stream_equals_batch(spark, tmp_path):
    rows = records(spark, [(f"induction motor {i}", f"{i + 1} kW, 415 V, 1440 rpm", None, {"Brand": "X"}) for i in range(30)] + [(" ", "nameless", None, None)])
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    paths = [f"{tmp_path}/{x}" for x in ("in", "store", "jobs", "checkpoint")]
    assert stream.run(spark, *paths, "job", files_per_batch=2) == 30
    want = {(r["product_id"], r["validation_score"]) for r in writers.stored_rows(enrich(rows).withColumn("result", F.lit("")), "job").filter("product_id < 30").collect()}
    assert {(r["product_id"], r["validation_score"]) for r in spark.read.parquet(paths[1]).collect()} == want
    last = writers.last_write(spark.read.parquet(paths[2]), "job_id", "seq").first()
    assert (last["status"], last["processed"]) == ("done", 30) and last["finished_at"] is not None


def test_sinks(spark, tmp_path):
    e = enrich(records(spark, [("induction motor", "2.2 kW, CE and UL", None, {"Brand": "X"}), ("ball valve", "DN50", None, None)]))
    writers.write_csv(e, f"{tmp_path}/csv")
    got = {r["name"]: r for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()}
    assert got["induction motor"]["spec_power"] == "2200 W" and got["induction motor"]["spec_brand"] == "X" and got["induction motor"]["spec_certifications"] == "CE, UL" and got["ball valve"]["spec_power"] is None
    writers.save(e, f"{tmp_path}/store", "j1")
    writers.save(e, f"{tmp_path}/store", "j2")
    assert spark.read.parquet(f"{tmp_path}/store").groupBy("job_id").count().count() == 2
    writers.write_json(e, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").filter("category.code = 'VLV.BALL'").count() == 1


def test_plain_explode_and_join_plan_quickly(spark):
    import time

    e = enrich(records(spark, [("induction motor", "2.2 kW", None, None)]))
    start = time.time()
    exploded = e.select("category.code", F.explode("specs").alias("v"))
    exploded.join(e.select("category.code", "product_id"), "code").filter("v.num > 0").count()
    assert time.time() - start < 30
