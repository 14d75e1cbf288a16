"""Repair of the order of speakers in conversations, by the cheapest edits.

The rows of a table are sorted once by conversation and turn, in ranges, so that a long conversation spans several
ranges. A conversation that lies in one range and one segment is repaired where it is read. Of the others each range
gives segments of bounded size. A segment acts on costs as a 4 x 4 matrix over the states (nothing yet, after system,
after user, after assistant), with minimum and sum in place of sum and product. The product of the matrices from the
end is the backward cost vector at each segment's end: these are the checkpoints. With its checkpoint a segment is
recomputed by itself, in blocks of the square root of its size, while one walk forward takes, of the edits that keep
the cost, the least letter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, staged

START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
RENAME, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
SPEAKER = {USER: "user", ASSISTANT: "assistant"}
#: The one speaker that may follow in each state, and where a system row may stand.
NEXT = (USER, USER, ASSISTANT, USER)
OPEN = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 1 << 20
TURNS = "array<struct<turn:long,role:string,text:string>>"
DONE = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
READ = f"{DONE}, edits array<struct<edit:string,role:string,text:string>>, part int, number long, turns {TURNS}"
SUMMED = f"conv_id {{id}}, part int, number long, turns {TURNS}, marks array<struct<initial:string,must_go:boolean,unfinished:boolean>>, matrix array<long>, counts array<long>, first string, last string, least long, most long, distinct long"
ENDS = "part int, number long, end array<long>, final boolean, totals array<long>"
WHITE = " \t\n\v\f\r"


def kept_as(initial: str, state: int) -> int | None:
    """The state after a row that is kept, or None where it may not stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    after = OPEN.get(initial)
    return after if after is not None and NEXT[state] == after else None


def before(after: list[int], initial: str, must_go: bool, unfinished: bool) -> list[int]:
    """The least cost to the end in each state before a row, from those after it."""
    fee = UNFINISHED * unfinished
    costs = []
    for state in range(4):
        best = after[state] + DELETE
        if not must_go:
            best = min(best, after[NEXT[state]] + RENAME + fee)
            to = kept_as(initial, state)
            if to is not None:
                best = min(best, after[to] + fee)
        costs.append(best)
    return inserted(costs)


def inserted(costs: list[int]) -> list[int]:
    """Costs when rows may be put in first; two in a row give every state."""
    for _ in range(2):
        costs = [min(c, costs[NEXT[s]] + INSERT) for s, c in enumerate(costs)]
    return costs


def at_end() -> list[int]:
    return inserted([0, FAR, FAR, 0])


def walk(marks: list[tuple[str, bool, bool]], end: list[int], state: int, last: bool) -> tuple[list[tuple[str, int]], int, int]:
    """The edits of a segment from a state on, (letter, state after it) each, the last state, and their cost with what follows.

    end holds the costs behind the segment, last says that nothing follows.

    Cost vectors are stored at every square root of the rows; the block between two of them is computed when the walk enters it.
    """
    n = len(marks)
    step = max(1, math.isqrt(n))
    stored, costs = {n: end}, end
    for i in range(n - 1, -1, -1):
        costs = before(costs, *marks[i])
        if i % step == 0:
            stored[i] = costs
    cost = costs[state]
    edits: list[tuple[str, int]] = []
    block: list[list[int]] = []
    for i in range(n + last):
        if i < n and i % step == 0:
            top = min(i + step, n)
            block = [stored[top]]
            for k in range(top - 1, i, -1):
                block.append(before(block[-1], *marks[k]))
            block.append(stored[i])
        here = block.pop() if i < n else end
        after = block[-1] if i < n else end
        while True:
            left = here[state]
            to = NEXT[state]
            if i < n:
                initial, must_go, unfinished = marks[i]
                fee = UNFINISHED * unfinished
                if after[state] + DELETE == left:
                    edits.append(("D", state))
                    break
            if here[to] + INSERT == left:
                edits.append(("I", to))
                state = to
                continue
            if i == n:
                break
            kept = None if must_go else kept_as(initial, state)
            if kept is not None and after[kept] + fee == left:
                edits.append(("K", kept))
                state = kept
            else:
                edits.append(("R", to))
                state = to
            break
    return edits, state, cost


Turn = tuple[int | None, str, str]


def marked(turns: list[Turn], seen: set[str] | None = None) -> tuple[list[tuple[str, bool, bool]], list[int]]:
    """(initial, must go, unfinished) of each row, and how many are blank, duplicate, truncated and next to a wrong speaker.

    seen holds the keys of rows of earlier segments.
    """
    marks, counts, met, last = [], [0, 0, 0, 0], set(), None
    for _, role, text in turns:
        body = text.rstrip(WHITE)
        blank = not body
        twice = not blank and ((role, text) in met or bool(seen) and key(role, text) in seen)
        open_end = not blank and not twice and body[-1] not in ".!?"
        met.add((role, text))
        counts[0] += blank
        counts[1] += twice
        counts[2] += open_end
        counts[3] += last is not None and last + role[:1] not in ("su", "ua", "au")
        last = role[:1]
        marks.append((last, blank or twice, open_end))
    return marks, counts


def key(role: str, text: str) -> str:
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()


def span(turns: list[Turn]) -> tuple[int | None, int | None, int]:
    known = [t for t, _, _ in turns if t is not None]
    return (known[0], known[-1], len({*known})) if known else (None, None, 0)


def gaps(least: int | None, most: int | None, distinct: int) -> int:
    return 0 if least is None else min(most - least + 1 - distinct, (1 << 63) - 1)


class Repaired:
    """The result of one conversation, segment by segment: its audit, a running hash, or its rows."""

    def __init__(self):
        self.state, self.digest, self.begun = START, hashlib.sha256(), False
        self.audit: list[str] = []

    def add(self, turns: list[Turn], marks: list[tuple[str, bool, bool]], end: list[int], last: bool) -> tuple[int, list[dict]]:
        """Walks one segment on; its cost with what follows, and its rows with their edits."""
        edits, self.state, cost = walk(marks, end, self.state, last)
        rows, at = [], 0
        for letter, state in edits:
            if letter == "I":
                role, text = SPEAKER[state], ""
            else:
                _, role, text = turns[at]
                at += 1
                role = SPEAKER[state] if letter == "R" else role
            rows.append({"edit": letter, "role": role, "text": text})
            if letter != "D":
                self.digest.update(("\n" * self.begun + f"{role}:{text}").encode())
                self.begun = True
        self.audit.append("".join(e for e, _ in edits))
        return cost, rows


def _done(conv: object, gap: int, counts: list[int], cost: int, repaired: Repaired) -> dict:
    return {"conv_id": conv, "gaps": gap, "blank": counts[0], "duplicate": counts[1], "truncated": counts[2], "illegal": counts[3], "cost": cost, "audit": "".join(repaired.audit), "repaired_sha256": repaired.digest.hexdigest()}


def _batches(rows: Iterator[dict], schema: pa.Schema, rows_most: int = 2000, chars_most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size."""
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(t["text"]) for t in row.get("turns") or row.get("edits") or ())
        if len(held) == rows_most or size > chars_most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _read(schema: pa.Schema, with_rows: bool, segment_rows: int):
    """Sorted rows to results of the conversations that surely end here, and segments of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[dict]:
            number, alone, begun, current = 0, False, False, None
            turns: list[Turn] = []
            size = 0

            def segment() -> dict:
                nonlocal number, turns, size
                out = {"conv_id": current, "part": part, "number": number, "turns": [{"turn": t, "role": r, "text": x} for t, r, x in turns]}
                number, turns, size = number + 1, [], 0
                return out

            for batch in batches:
                for conv, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if not begun or conv != current:
                        if begun and alone:
                            yield _whole(current, turns, with_rows)
                            turns, size = [], 0
                        elif begun:
                            yield segment()
                        alone, current, begun = begun, conv, True
                    for _ in range(copies):
                        turns.append((turn, role, text))
                        size += len(text)
                        if len(turns) == segment_rows or size > SEGMENT_CHARS:
                            yield segment()
                            alone = False
            if begun:
                yield segment()

        yield from _batches(rows(), schema)

    return run


def _whole(conv: object, turns: list[Turn], with_rows: bool) -> dict:
    marks, counts = marked(turns)
    repaired = Repaired()
    cost, rows = repaired.add(turns, marks, at_end(), True)
    return _done(conv, gaps(*span(turns)), counts, cost, repaired) | ({"edits": rows} if with_rows else {})


def _sum(schema: pa.Schema):
    """Segments with the keys seen before them to marks, counts and the matrix of costs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for s in (row for batch in batches for row in batch.to_pylist()):
                turns = [(t["turn"], t["role"], t["text"]) for t in s["turns"]]
                marks, counts = marked(turns, {*(s.pop("seen") or ())})
                columns = []
                for state in range(4):
                    costs = [FAR] * 4
                    costs[state] = 0
                    for mark in reversed(marks):
                        costs = before(costs, *mark)
                    columns.append(costs)
                least, most, distinct = span(turns)
                yield s | {"marks": [dict(zip(("initial", "must_go", "unfinished"), m, strict=True)) for m in marks], "matrix": [min(columns[t][f], FAR) for f in range(4) for t in range(4)], "counts": counts, "first": marks[0][0] if marks else None, "last": marks[-1][0] if marks else None, "least": least, "most": most, "distinct": distinct}

        yield from _batches(rows(), schema)

    return run


def _ends(summary: pa.Table) -> pa.Table:
    """One small row per segment of a conversation, from its end: the costs behind each, and the totals."""
    rows = sorted(summary.to_pylist(), key=lambda r: (r["part"], r["number"]))
    costs, ends = at_end(), []
    for row in reversed(rows):
        ends.append(costs)
        own = np.asarray(row["matrix"], np.int64).reshape(4, 4) + np.asarray(costs, np.int64)
        costs = np.minimum(own.min(axis=1), FAR).tolist()
    counts = np.array([row["counts"] for row in rows], np.int64).sum(axis=0).tolist()
    least = most = previous = None
    distinct = 0
    for row in rows:
        if row["first"] is not None:
            counts[3] += previous is not None and previous + row["first"] not in ("su", "ua", "au")
            previous = row["last"]
        if row["least"] is not None:
            distinct += row["distinct"] - (most == row["least"])
            least, most = row["least"] if least is None else least, row["most"]
    totals = [gaps(least, most, distinct), *counts, costs[START]]
    found = [{"part": row["part"], "number": row["number"], "end": end, "final": row is rows[-1], "totals": totals} for row, end in zip(rows, reversed(ends), strict=True)]
    return pa.Table.from_pylist(found, pa.schema([("part", pa.int32()), ("number", pa.int64()), ("end", pa.list_(pa.int64())), ("final", pa.bool_()), ("totals", pa.list_(pa.int64()))]))


def _forward(schema: pa.Schema, with_rows: bool):
    """Segments in order with the costs behind them to the results of their conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            repaired = Repaired()
            for s in (row for batch in batches for row in batch.to_pylist()):
                turns = [(t["turn"], t["role"], t["text"]) for t in s["turns"]]
                marks = [(m["initial"], m["must_go"], m["unfinished"]) for m in s["marks"]]
                _, edits = repaired.add(turns, marks, s["end"], s["final"])
                if with_rows:
                    yield {"conv_id": s["conv_id"], "part": s["part"], "number": s["number"], "edits": edits}
                if s["final"]:
                    gap, blank, twice, open_end, illegal, cost = s["totals"]
                    yield _done(s["conv_id"], gap, [blank, twice, open_end, illegal], cost, repaired)
                    repaired = Repaired()

        yield from _batches(rows(), schema)

    return run


def _arrow(schema: str, df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema.format(id=df.schema["conv_id"].dataType.simpleString())))


def _run(turns: DataFrame, with_rows: bool, segment_rows: int) -> DataFrame:
    read, summed = (text.format(id=turns.schema["conv_id"].dataType.simpleString()) for text in (READ, SUMMED))
    copies = F.col("copies").cast("int") if "copies" in turns.columns else F.lit(1)
    named = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.coalesce(copies, F.lit(1)).alias("copies"))
    ranges = named.repartitionByRange(shuffle_parts(turns.sparkSession), "conv_id", "turn", F.substring("role", 1, 8), F.substring("text", 1, 8))
    found = staged(ranges.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_read(_arrow(READ, turns), with_rows, segment_rows), read), "turns")
    whole, parts = found.filter("part IS NULL"), found.filter("part IS NOT NULL").select("conv_id", "part", "number", "turns")
    keys = parts.select("conv_id", "part", "number", F.explode(F.array_distinct(F.transform("turns", lambda t: F.sha2(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], F.lit(":"), t["text"]), 256)))).alias("key"))
    again = keys.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "key").orderBy("part", "number"))).filter("nth > 1")
    seen = again.groupBy("part", "number").agg(F.collect_list("key").alias("seen"))
    segments = staged(parts.join(seen, ["part", "number"], "left").select("conv_id", "part", "number", "turns", "seen").mapInArrow(_sum(_arrow(SUMMED, turns)), summed), "segments")
    ends = segments.drop("turns", "marks").groupBy("conv_id").applyInArrow(_ends, ENDS)
    ordered = segments.join(ends, ["part", "number"]).select("conv_id", "part", "number", "turns", "marks", "end", "final", "totals").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return whole.unionByName(ordered.mapInArrow(_forward(_arrow(READ, turns), with_rows), read))


def repair(turns: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    turns holds conv_id, turn, role, text and, if wanted, copies: how often a row stands (0: it only names the
    conversation). A conversation's rows are taken by turn, nulls first; rows of one turn by role, then text. A null
    role or text is one space; a null conv_id is a conversation of its own. Repeated rows stand each, and all but the
    first are duplicates. An empty table gives no rows, a conversation without rows zeros, an empty audit and the hash
    of an empty string; other columns are ignored. Very long texts are kept whole; one text is never cut. Of equally
    cheap edits the ASCII-least audit counts. A conversation of any length is cut into segments; only its hash, which
    needs all its text in order, and one small row per segment are made by one task, in bounded memory.
    """
    return _run(turns, False, segment_rows).filter("repaired_sha256 IS NOT NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def edited(turns: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The rows that repair keeps, renames, inserts and deletes: conv_id, part, number, place, edit, role, text, in that order."""
    rows = _run(turns, True, segment_rows).filter("edits IS NOT NULL")
    return rows.select("conv_id", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("number", F.lit(0)).alias("number"), F.posexplode("edits").alias("place", "edits")).select("conv_id", "part", "number", "place", "edits.*")


def damaged(rows: DataFrame) -> DataFrame:
    """conversations rows with one fault in five: dropped, emptied, without end marks, doubled, or all by the user."""
    whole = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    named = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(named.cast("binary")) % 20
    changed = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return whole.withColumn("fault", fault).select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))
