"""Conversation repair against SQL and a plain search over all edit sequences."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from compare import same

from specforge.llm import turns
from specforge.llm.queries import oracle_sql, queries

KIND = "conv_id long, turn long, role string, text string, part int, edits string"


def cheapest(rows):
    """Best-first search over (cost, audit); states are the rows taken and the last speaker."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return faults, cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        if (i, last) in done or cost > 1000:
            continue
        done.add((i, last))
        speaker = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", i, speaker[0], (*out, (speaker, ""))))
        if i == len(rows):
            continue
        role, text = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
        if faults[i] in ("blank", "duplicate"):
            continue
        fee = 5 * (faults[i] == "truncated")
        if role[:1] == "s" and last == "" or role[:1] in ("u", "a") and role[:1] == speaker[0]:
            heapq.heappush(heap, (cost + fee, audit + "K", i + 1, role[:1], (*out, (role, text))))
        heapq.heappush(heap, (cost + fee + 1, audit + "R", i + 1, speaker[0], (*out, (speaker, text))))


def plain(data):
    """Every conversation, damaged and repaired."""
    kept = defaultdict(list)
    for conv, turn, role, text, *_ in data:
        own = kept[conv]
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = []
    for conv, rows in kept.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, cost, audit, text = cheapest([r[1:] for r in rows])
        known = [r[0] for r in rows if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len({*known}) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def made_up(seed, sizes):
    rnd = random.Random(seed)
    rows = []
    for conv, n in enumerate(sizes):
        for k in range(n):
            turn = rnd.choice([None, k, k, k, k + 3])
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Yes.", "No", "", None, " \n", f"It is {rnd.randint(0, 40)}.", f"é☃ {k}!", "what? \t", "x" * 300 + "."])
            rows.append((None if conv == 3 else conv, turn, role, text, 1, "x"))
    return rows + rows[:5]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    same(spark, queries()["op13_conversation_repair"], oracle_sql()["op13_conversation_repair"], f"/root/testdata/{sf}")


def test_odd_rows_against_plain_search_and_sql(spark, tmp_path):
    data = made_up(1, [*range(1, 12)] * 6 + [200, 0, 57])
    spark.createDataFrame(data, KIND).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, queries()["op13_conversation_repair"](spark, str(tmp_path)).collect()), key=repr) == plain(data)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted(con.execute(oracle_sql()["op13_conversation_repair"]).fetchall(), key=repr) == plain(data)


@pytest.mark.parametrize("segment_rows", [1, 3, 40])
def test_conversations_over_many_segments(spark, segment_rows):
    data = made_up(2, [400, 3, 90, 1, 30])
    rows = turns.damaged(spark.createDataFrame(data, KIND))
    assert sorted(map(tuple, turns.repair(rows, segment_rows).collect()), key=repr) == plain(data)


def test_edited_rows_give_the_hash(spark):
    data = made_up(4, [60, 2, 9, 14])
    rows = turns.damaged(spark.createDataFrame(data, KIND))
    digests = {r.conv_id: (r.audit, r.repaired_sha256) for r in turns.repair(rows).collect()}
    found = defaultdict(list)
    for r in turns.edited(rows, 7).orderBy("part", "number", "place").collect():
        found[r.conv_id].append(r)
    for conv, own in found.items():
        text = "\n".join(f"{r.role}:{r.text}" for r in own if r.edit != "D")
        assert digests[conv] == ("".join(r.edit for r in own), hashlib.sha256(text.encode()).hexdigest())


def test_least_letters_win_and_empty_tables_give_no_rows(spark):
    kept = [("a", "u", "Hi."), ("a", "u", "There."), ("b", "s", "Be kind.")]
    rows = spark.createDataFrame([(c, i, {"u": "user", "s": "system"}[r], t) for i, (c, r, t) in enumerate(kept)], "conv_id string, turn long, role string, text string")
    assert {(r.conv_id, r.cost, r.audit) for r in turns.repair(rows).collect()} == {("a", 1, "KR"), ("b", 2, "D")}
    assert turns.repair(rows.limit(0)).collect() == []
