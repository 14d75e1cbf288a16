"""A model's client: lists of prompts, deadlines, retries, and what late or failing answers leave."""

import time

from specforge.operators import proposals


def prompted(spark, n):
    return spark.createDataFrame([(i, f"p{i}") for i in range(n)], "product_id long, prompt string").coalesce(1)


def replies(df):
    return {r["product_id"]: r["reply"] for r in df.collect()}


def test_answers_come_in_lists(spark):
    got = replies(proposals.ask(prompted(spark, 50), lambda ps: [f"{p}/{len(ps)}" for p in ps], size=16))
    assert got == {i: f"p{i}/{16 if i < 48 else 2}" for i in range(50)}


def test_a_client_that_hangs_leaves_gaps_in_time(spark):
    def client(prompts):
        if "p5" in prompts:
            time.sleep(120)
        return ["ok"] * len(prompts)

    start = time.time()
    got = replies(proposals.ask(prompted(spark, 12), client, size=4, seconds=1.0))
    assert got == {i: None if 4 <= i < 8 else "ok" for i in range(12)} and time.time() - start < 60


def test_nothing_is_asked_once_all_workers_hang(spark):
    start = time.time()
    got = replies(proposals.ask(prompted(spark, 400), lambda ps: time.sleep(120), size=1, workers=2, seconds=0.5))
    assert set(got.values()) == {None} and time.time() - start < 60


def test_a_failed_list_is_asked_again(spark):
    seen = []

    def client(prompts):
        seen.append(1)
        if len(seen) == 1:
            raise ValueError("busy")
        return ["short"] if len(seen) == 2 else ["ok"] * len(prompts)

    assert set(replies(proposals.ask(prompted(spark, 3), client, retries=2)).values()) == {"ok"}
    seen.clear()
    assert set(replies(proposals.ask(prompted(spark, 3), client, retries=1)).values()) in ({None}, {"ok"})


def test_without_a_provider_nothing_is_asked(spark):
    for choose in (lambda: None, lambda: time.sleep(60), lambda: 1 / 0):
        assert set(replies(proposals.ask(prompted(spark, 3), lambda ps: ["no"] * len(ps), choose=choose, choose_seconds=0.5)).values()) == {None}
    assert set(replies(proposals.ask(prompted(spark, 3), lambda ps: ["yes"] * len(ps), choose=lambda: "a")).values()) == {"yes"}
