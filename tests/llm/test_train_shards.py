"""Shards of the training order: written by the query, read from any slot, repeated one at a time."""

from pathlib import Path

import numpy as np
import pytest

from specforge.llm import trainorder
from specforge.llm.queries import queries

SF = "/root/testdata/sf0.001"
ROWS = 64


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shards") / "own")
    sequences = trainorder.materialise(spark.read.parquet(f"{SF}/documents.parquet"), shard_rows=ROWS)
    trainorder.write_shards(sequences, path)
    return sequences, path, sorted(map(tuple, sequences.collect()))


def files(path):
    return sorted(Path(path).glob("shard=*/*.parquet"))


def test_query_rows_come_from_shards(spark):
    got = queries()["op7_train_order"](spark, SF)
    names = got.inputFiles()
    assert names and all("/shards-" in x and "/shard=" in x for x in names)
    expected = trainorder.materialise(spark.read.parquet(f"{SF}/documents.parquet"))
    assert got.columns == expected.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_one_file_per_shard_in_slot_order(written):
    import pyarrow.parquet as pq

    _, path, rows = written
    shards = -(-len(rows) // ROWS)
    assert shards > 3 and [f.parent.name for f in files(path)] == sorted(f"shard={k}" for k in range(shards))
    for f in files(path):
        own = pq.ParquetFile(f).read()
        k = int(f.parent.name.split("=")[1])
        assert own["slot"].to_pylist() == list(range(k * ROWS, min((k + 1) * ROWS, len(rows))))
        assert {len(x) for x in own["ids"].to_pylist()} == {2 * trainorder.SEQUENCE}


def test_reading_from_a_slot_in_the_middle(spark, written):
    sequences, path, rows = written
    got = trainorder.read_from(spark, path, ROWS + 40, 100, ROWS).select(*sequences.columns)
    assert [tuple(r) for r in got.collect()] == rows[ROWS + 40 : ROWS + 140]
    assert trainorder.invert(np.arange(len(rows)), len(rows), trainorder.KEY)[trainorder.permute(np.array([5]), len(rows), trainorder.KEY)[0]] == 5


def test_repeating_a_shard_leaves_the_others(spark, written):
    sequences, path, rows = written
    before = {f: f.read_bytes() for f in files(path)}
    for f in list(before):
        if f.parent.name == "shard=2":
            f.unlink()
    trainorder.write_shards(sequences, path, [2])
    after = {f: f.read_bytes() for f in files(path)}
    kept = {f: x for f, x in before.items() if f.parent.name != "shard=2"}
    assert len(after) == len(before) and kept.items() <= after.items()
    again = trainorder.read_from(spark, path, 0, len(rows), ROWS).select(*sequences.columns)
    assert [tuple(r) for r in again.collect()] == rows


def test_one_order_however_the_input_is_cut(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {(r["doc_id"], r["start"]): r["slot"] for r in trainorder.materialise(docs).collect()}
    for parts in (3, 5):
        assert {(r["doc_id"], r["start"]): r["slot"] for r in trainorder.materialise(docs.repartition(parts)).collect()} == want


def test_shards_written_in_passes_are_those_of_one_job(spark, written):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for rows in (7, ROWS):
        want = written[2] if rows == ROWS else sorted(map(tuple, trainorder.materialise(docs, shard_rows=rows).collect()))
        got = trainorder.sharded(docs, shard_rows=rows)
        assert len(got.inputFiles()) == -(-len(want) // rows)
        assert sorted(map(tuple, got.collect())) == want
    assert trainorder.sharded(docs.limit(0)).collect() == []
    assert len(trainorder.sharded(docs.limit(1), shard_rows=10**6).collect()) > 0
