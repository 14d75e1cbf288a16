"""Hard negatives against SQL and plain loops over integers of any size."""

import random

import numpy as np
import pytest
from compare import same

from specforge.llm import hardneg
from specforge.llm.queries import oracle_sql, queries

KIND = "vec_id long, label int, embedding array<float>, row long, block string"


def plain(rows, every=100, low=30, high=90):
    """rows: (vec_id, label, parts); the same answer by comparing everything."""
    width = max(len(p) for _, _, p in rows)
    rows = [(i, lab, [*p, *[0] * (width - len(p))]) for i, lab, p in rows]
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for k, (i, lab, p) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(p, q, strict=True)), j, m) for n, (j, m, q) in enumerate(rows) if n != k]
        near = sorted(((s, j) for s, j, m in scored if m == lab), key=order)[:5]
        for ps, pid in near:
            away = sorted(((s, j) for s, j, m in scored if m != lab and low * ps <= 100 * s <= high * ps), key=order)[:10]
            out += [(i, pid, r, j, ps, s) for r, (s, j) in enumerate(away, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    same(spark, queries()["op12_hard_negatives"], oracle_sql()["op12_hard_negatives"], f"/root/testdata/{sf}")


def test_scores_are_exact_at_any_size():
    rng = np.random.default_rng(1)
    for most, width in ((3, 1), (160, 64), (40_000, 3000), (100_000_000, 5)):
        a, b = rng.integers(-most, most + 1, (7, width)), rng.integers(-most, most + 1, (9, width))
        a[0], b[0], b[1] = most, most, -most
        primes = hardneg.primes_for(width * most**2)
        assert (hardneg.scores(hardneg.residues(a, primes), hardneg.residues(b, primes), primes) == a @ b.T).all()


def test_odd_rows_against_plain_loops(spark, tmp_path):
    rnd = random.Random(3)
    data = []
    for k in range(400):
        i = rnd.choice([None, *range(0, 2000, 50)]) if k % 3 == 0 else k
        data.append((i, rnd.choice([0, 0, 0, 1, 2, None]), [rnd.randint(-3, 9) / 4 for _ in range(rnd.choice([3, 4, 4, 4]))], k, "x"))
    data += [(100, 1, None, 0, None), (200, 1, [1.0, None], 0, None), (300, 1, [float("nan")], 0, None), (400, 2, [float("inf")], 0, None), (500, 2, [], 0, None), (600, 0, [1.0, 1.0, 1.0], 0, None), (600, 0, [1.0, 1.0, 1.0], 0, None)]
    spark.createDataFrame(data, KIND).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [int(np.floor(256 * np.float64(x))) for x in v]) for i, lab, v, _, _ in data if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    wanted = plain(rows)
    assert len(wanted) > 500
    assert sorted(map(tuple, queries()["op12_hard_negatives"](spark, str(tmp_path)).collect()), key=repr) == wanted
    parts = spark.createDataFrame(rows, "vec_id long, label int, parts array<long>")
    assert sorted(map(tuple, hardneg.mine(parts, block_rows=17, group_anchors=9).collect()), key=repr) == wanted


def test_scores_beyond_64_bits_are_refused(spark):
    with pytest.raises(ValueError, match="64 bits"):
        hardneg.mine(spark.createDataFrame([(100, 1, [1 << 40] * 4)], "vec_id long, label int, parts array<long>"))


def test_empty_tables_give_no_rows(spark):
    for rows in ([], [(None, None, None)], [(100, 1, [1])]):
        assert hardneg.mine(spark.createDataFrame(rows, "vec_id long, label int, parts array<long>")).collect() == []
