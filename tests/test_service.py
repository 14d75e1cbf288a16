"""Whole runs over a store, and streams that keep what they met."""

import json

import pytest
from pyspark.sql import functions as F

from specforge.operators import evaluate
from specforge.plans import service
from specforge.plans.pipeline import enrich
from specforge.sinks import writers
from specforge.sinks.store import Store
from specforge.streaming import stream

RAW = "product_id long, name string, description string, category string, source string, source_ref string, attributes map<string,string>"
ROWS = [
    (1, "Motor 11 kW 415 V three phase foot mounted induction", "", "", "x", "a", {}),
    (2, "Motor 11 kW  415V three-phase foot mounted induction", "", "", "x", "b", {}),
    (3, "ball valve", "DN50", None, "x", "c", {"Brand": "ABB"}),
    (4, " ", "nameless", None, "x", "d", None),
]


@pytest.fixture
def store(spark, tmp_path, request):
    name = f"s{abs(hash(request.node.name)) % 10**8}"
    yield Store(spark, name, str(tmp_path), buckets=4)
    for which in ("documents", "cache", "vectors"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{which}")


def raw(spark, rows=ROWS):
    return spark.createDataFrame(rows, RAW)


def test_a_second_run_computes_nothing(spark, store):
    first = {r["product_id"]: r for r in service.run(raw(spark), store, "j1").collect()}
    assert {k: (r["cache"], r["persisted"]) for k, r in first.items()} == {1: ("miss", True), 2: ("miss", True), 3: ("miss", True)}
    assert json.loads(first[3]["result"])["category"]["code"] == "VLV.BALL"
    again = {r["product_id"]: r for r in service.run(raw(spark), store, "j2").collect()}
    assert {k: (r["cache"], r["persisted"]) for k, r in again.items()} == {k: ("hit", False) for k in (1, 2, 3)}
    assert {k: r["result"] for k, r in again.items()} == {k: r["result"] for k, r in first.items()}
    assert store.table("documents").count() == 3 and store.table("documents").filter("result IS NULL").count() == 0


def test_what_a_cache_serves_still_reaches_the_store(spark, store):
    service.run(raw(spark), store, persist=False).collect()
    assert store.table("documents").count() == 0
    got = {r["product_id"]: (r["cache"], r["persisted"]) for r in service.run(raw(spark), store, "late").collect()}
    assert got == {1: ("hit", True), 2: ("hit", False), 3: ("hit", True)}  # 1 and 2 have one hash
    kept = {r["product_id"]: r for r in store.table("documents").collect()}
    want = {r["product_id"]: r for r in writers.stored_rows(enrich(service.named(raw(spark)))).collect()}
    for k in kept:
        assert [kept[k][c] for c in ("content_hash", "name", "category", "spec_count", "validation_score", "completeness", "llm_used")] == [want[k][c] for c in ("content_hash", "name", "category", "spec_count", "validation_score", "completeness", "llm_used")]


def test_expired_results_are_computed_again(spark, store):
    service.run(raw(spark), store, lasts="timestamp'2020-01-01'").collect()
    assert {r["cache"] for r in service.run(raw(spark), store).collect()} == {"miss"}


def test_new_records_are_compared_with_the_index(spark, store):
    service.run(raw(spark, ROWS[:1]), store).collect()
    got = {r["product_id"]: [d["id"] for d in r["duplicates"] or ()] for r in service.run(raw(spark, ROWS[1:]), store).collect()}
    assert got == {2: [1], 3: []}
    assert {r["product_id"] for r in store.index().collect()} == {1, 2, 3}


def test_the_store_is_not_shuffled_for_a_look_up(spark, store):
    service.run(raw(spark), store).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = service.keyed(service.named(raw(spark)))
        plan = asked.join(store.cached(), "cache_key", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_catalogue_run_gives_checks_and_documents(spark, store):
    got = service.enrich_catalogue(raw(spark), store, "cat")
    assert got["summary"].first()["total"] == 3 and got["score"].first()["records"] == 3
    assert [r["n"] for r in got["duplicates"].collect()] == [2]
    assert store.table("documents").filter("job_id = 'cat' AND result IS NOT NULL").count() == 3


def test_an_empty_run(spark, store):
    assert service.run(raw(spark, []), store).collect() == []


def test_repeated_files_store_nothing_twice(spark, tmp_path):
    rows = raw(spark, [(i, f"induction motor {i % 20}", f"{i % 20 + 1} kW", None, "x", None, {}) for i in range(30)])
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    paths = [f"{tmp_path}/{x}" for x in ("in", "store", "jobs", "checkpoint")]
    assert stream.run(spark, *paths, "job", files_per_batch=1) == 20
    rows.write.mode("append").parquet(paths[0])
    raw(spark, ROWS[2:3]).write.mode("append").parquet(paths[0])
    assert stream.run(spark, *paths, "job", files_per_batch=1) == 21
    kept = spark.read.parquet(paths[1])
    assert kept.count() == 21 == kept.select("name").distinct().count()
    want = {r["name"]: json.loads(r["result"])["category"] for r in writers.stored_rows(enrich(rows.filter("product_id < 20"))).collect()}
    assert {r["name"]: json.loads(r["result"])["category"] for r in kept.filter("name <> 'ball valve'").collect()} == want
    jobs = stream.job_rows(spark, paths[2]).filter("status = 'running'").orderBy("seq").collect()
    assert [r["processed"] for r in jobs] == sorted(r["processed"] for r in jobs) and jobs[-1]["processed"] == 21


def test_a_failing_batch_fails_the_job(spark, tmp_path, monkeypatch):
    raw(spark).write.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(stream, "stored_rows", lambda *a: (_ for _ in ()).throw(ValueError("disk")))
    with pytest.raises(Exception, match="disk"):
        stream.run(spark, *[f"{tmp_path}/{x}" for x in ("in", "store", "jobs", "checkpoint")], "job")
    last = writers.last_write(stream.job_rows(spark, f"{tmp_path}/jobs"), "job_id", "seq").first()
    assert last["status"] == "failed" and last["finished_at"] is not None


def test_labelled_cases_from_a_file(spark, tmp_path):
    cases = [("three phase induction motor 3 HP 415 V", "Three-phase motor, IP55", "Electric Motor", {"power": "3 HP", "voltage": "415 V", "ip_rating": "IP55"}), ("ball valve DN50", "full bore", "Ball Valve", {"nominal_bore": "DN50"})]
    lines = ["// labelled by hand", ""] + [json.dumps({"name": n, "description": d, "expected_category": c, "expected_specs": s}) for n, d, c, s in cases]
    (tmp_path / "cases.jsonl").write_text("\n".join(lines))
    loaded = evaluate.load_cases(spark, f"{tmp_path}/cases.jsonl")
    records = loaded.select(F.col("case_id").alias("product_id"), "name", "description", F.col("input_category").alias("category"), "attributes")
    got = evaluate.aggregate(evaluate.per_case(loaded, enrich(records))).first()
    assert got["cases"] == 2 and got["recall"] >= 0.9 and got["hallucination_rate"] <= 0.05
