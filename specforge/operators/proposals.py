"""Gaps that a model may fill: prompts out, replies in, a merge that never outranks the source. No model is called unless one is given."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import AMBIGUOUS_CATEGORY, FIELDS, PROPOSABLE
from ..functions.sql import let, quote, strip
from ..functions.text import normalise_key_sql
from ..functions.units import canonical_sql, resolve_sql
from ..sinks.writers import display
from .classify import leaves
from .derive import describe
from .extract import NONE, SPEC, listed, spec

FENCES = r"^```(?:json)?\s*|\s*```$"
REPLY = "struct<specifications:map<string,string>,attributes:array<string>,description:string,category_suggestion:string>"


def wanted() -> str:
    """SQL of the expected fields that a record lacks."""
    return "array_except(category.expected, transform(specs, v -> v.field))"


def prompts(enriched: DataFrame) -> DataFrame:
    """product_id and prompt: what is known, and which fields to fill."""
    known = f"to_json(map_from_entries(transform(specs, v -> struct(v.field, {display('v')}))))"
    text = f"concat('Product: ', coalesce(name, ''), '\\nText: ', coalesce(description, ''), '\\nCategory: ', category.name, '\\nKnown, not to be changed: ', {known}, '\\nFill only, if the text states or implies it: ', array_join({wanted()}, ', '), '\\nAnswer with one JSON object: specifications (field to value, unit, basis), attributes, description, category_suggestion.')"
    return enriched.selectExpr("product_id", f"{text} AS prompt")


class Calls:
    """Calls of a client in daemon threads: what takes too long is given up, and its thread is left behind.

    After as many threads left behind as there are workers nothing more is asked, so a client that hangs costs a task a
    bounded time and a bounded number of threads.
    """

    def __init__(self, workers: int, seconds: float):
        self.workers, self.seconds, self.lost = workers, seconds, 0

    def each(self, call: Callable, args: list, seconds: float | None = None) -> list[tuple[str, object]]:
        """For each argument ("done", result), ("failed", error) or ("late", None); as many at a time as there are workers."""
        out: list[tuple[str, object]] = []
        for at in range(0, len(args), self.workers):
            if self.lost >= self.workers:
                out += [("late", None)] * len(args[at : at + self.workers])
                continue
            boxes = [self._start(call, x) for x in args[at : at + self.workers]]
            until = time.monotonic() + (seconds or self.seconds)
            for thread, box in boxes:
                thread.join(max(0.0, until - time.monotonic()))
                self.lost += not box
                out.append(box[0] if box else ("late", None))
        return out

    @staticmethod
    def _start(call: Callable, arg: object) -> tuple[threading.Thread, list]:
        box: list = []

        def run() -> None:
            try:
                box.append(("done", call(arg)))
            except Exception as error:  # a model that fails leaves the gaps as they are
                box.append(("failed", error))

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return thread, box


def ask(prompted: DataFrame, client: Callable[[list[str]], list[str | None]], choose: Callable[[], object] | None = None, size: int = 16, workers: int = 4, seconds: float = 45.0, choose_seconds: float = 10.0, retries: int = 1) -> DataFrame:
    """product_id and reply from a client that answers lists of prompts.

    Lists of at most size prompts are asked by workers at a time, each within a deadline. A list that fails, or has
    another length, is asked again, as often as retries says; one that is late is not. What has no answer has a null
    reply. choose, if given, picks a provider once per task within its own deadline; nothing is asked without one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = Calls(workers, seconds)
        ready = choose is None or (lambda r: r[0] == "done" and bool(r[1]))(calls.each(lambda _: choose(), [None], choose_seconds)[0])
        for pdf in batches:
            prompts = pdf["prompt"].tolist()
            parts = [prompts[i : i + size] for i in range(0, len(prompts), size)]
            replies: list[list[str | None]] = [[None] * len(p) for p in parts]
            rest = list(range(len(parts))) if ready else []
            for _ in range(retries + 1):
                found = calls.each(client, [parts[i] for i in rest])
                again = []
                for i, (state, value) in zip(rest, found, strict=True):
                    if state == "done" and isinstance(value, list | tuple) and len(value) == len(parts[i]):
                        replies[i] = [v if isinstance(v, str) else None for v in value]
                    elif state != "late":
                        again.append(i)
                rest = again
            yield pd.DataFrame({"product_id": pdf["product_id"], "reply": [r for part in replies for r in part]})

    return prompted.mapInPandas(run, "product_id long, reply string")


def json_object(text: str) -> str:
    """SQL of the JSON object in a reply: fences are dropped; failing that, the first balanced {...}. Null if there is none.

    Braces are counted over the characters from the first one on; the object ends where the count is back at zero.
    """
    plain = f"regexp_replace({strip(text)}, r'{FENCES}', '')"
    is_object = lambda x: f"(startswith({x}, '{{') AND try_parse_json({x}) IS NOT NULL)"
    ends = "transform(filter(sequence(1, length(b)), i -> substring(b, i, 1) = '}}'), i -> i)".replace("}}", "}")
    depth = lambda x: f"length(regexp_replace({x}, r'[^{{]', '')) - length(regexp_replace({x}, r'[^}}]', ''))"
    cut = let(f"get(filter({ends}, i -> {depth('substring(b, 1, i)')} = 0), 0)", "e", f"if(e IS NULL, null, {let('substring(b, 1, e)', 'o', f'if({is_object("o")}, o, null)')})")
    return let(plain, "p", f"CASE WHEN {is_object('p')} THEN p WHEN try_parse_json(p) IS NOT NULL OR instr(p, '{{') = 0 THEN null ELSE {let('substring(p, instr(p, ' + quote('{') + '))', 'b', cut)} END")


def merge(enriched: DataFrame, replies: DataFrame) -> DataFrame:
    """enriched with the replies' values where nothing better is known: s, specs, description, attributes, alternatives, accepted, rejected.

    A proposal is rejected if its field is outside the schema, known from source or text, without a usable value, of an
    unknown unit, or outranked by what is there. Of several proposals for one field the first that is accepted counts.
    Records without a reply, or with one that is no JSON object, stay as they are.
    """
    read = replies.selectExpr("product_id AS _id", f"from_json({json_object('reply')}, '{REPLY}') AS _r")
    joined = enriched.join(read, enriched["product_id"] == read["_id"], "left")
    field, value = normalise_key_sql("p.key"), "if(startswith(p.value, '{'), from_json(p.value, 'struct<value:string,unit:string,basis:string>'), named_struct('value', p.value, 'unit', cast(null as string), 'basis', cast(null as string)))"
    pairs = f"transform(map_entries(coalesce(_r.specifications, map())), p -> named_struct('key', p.key, 'field', {field}, 'x', {value}))"
    unit = f"named_struct('key', q.key, 'field', q.field, 'x', q.x, 'unit', if(coalesce(q.x.unit, '') = '', null, {resolve_sql('q.x.unit')}), 'known', get(filter(specs, v -> v.field = q.field), 0))"
    reason = f"CASE WHEN q.field NOT IN ({', '.join(map(quote, PROPOSABLE))}) THEN 'not in the schema' WHEN q.known.origin IN ('input', 'extracted') THEN 'known from the source' WHEN q.x.value IS NULL THEN 'no usable value' WHEN coalesce(q.x.unit, '') <> '' AND (q.unit IS NULL OR try_cast(q.x.value as double) IS NULL) THEN 'unknown unit' WHEN q.known IS NOT NULL THEN 'outranked' END"
    number = f"if(q.unit IS NULL, try_cast(q.x.value as double), {canonical_sql('try_cast(q.x.value as double)', 'q.unit')})"
    made = spec("q.field", num=number, text="if(try_cast(q.x.value as double) IS NULL AND NOT startswith(q.x.value, '['), q.x.value, null)", items="if(startswith(q.x.value, '['), from_json(q.x.value, 'array<string>'), null)", unit="q.unit.unit", origin="llm", confidence=0.6, rule="LLM.SPEC_GAPFILL", raw="q.x.basis")
    judged = joined.selectExpr("*", f"transform({pairs}, q -> {unit}) AS _p").selectExpr("*", f"transform(_p, q -> named_struct('key', q.key, 'field', q.field, 'reason', {reason}, 'spec', cast({made} as {SPEC}))) AS _j")
    judged = judged.selectExpr("*", "transform(filter(_j, (q, i) -> q.reason IS NULL AND NOT exists(slice(_j, 1, i), e -> e.reason IS NULL AND e.field = q.field)), q -> q.spec) AS _new")
    own = ", ".join(f"'{f}', coalesce(s.{f}, get(filter(_new, v -> v.field = '{f}'), 0), {NONE})" for f in FIELDS)
    rest = [f"`{c}`" for c in enriched.columns if c not in ("s", "specs", "extra_attributes", "alternatives", "enriched_description")]
    suggested = f"get(filter({leaves()}, x -> lower(x.name) = lower({strip('_r.category_suggestion')}) OR x.code = upper({strip('_r.category_suggestion')})), 0)"
    first = "array(named_struct('code', x.code, 'name', x.name, 'score', cast(null as double), 'confidence', 0.6D, 'matched', array('suggested by the model'), 'penalised', cast(array() as array<string>)))"
    described = f"if(length({strip('_r.description')}) > 30, {strip('_r.description')}, enriched_description) AS enriched_description"
    out = judged.selectExpr(
        *rest, f"named_struct({own}) AS s", f"concat(extra_attributes, transform(filter(coalesce(_r.attributes, cast(array() as array<string>)), a -> length(a) BETWEEN 4 AND 119), a -> {strip('a')})) AS extra_attributes", described,
        let(f"if(category.confidence < {AMBIGUOUS_CATEGORY!r}D, {suggested}, null)", "x", f"if(x IS NULL, alternatives, concat({first}, alternatives))") + " AS alternatives",
        "transform(_new, v -> v.field) AS accepted", "transform(filter(_j, q -> q.reason IS NOT NULL), q -> named_struct('key', q.key, 'reason', q.reason)) AS rejected",
    )
    return out.selectExpr("*", f"{listed()} AS specs")


def redescribe(merged: DataFrame) -> DataFrame:
    """merged with a description from the template where it has none."""
    given = describe(merged.withColumnRenamed("enriched_description", "_given"))
    return given.withColumn("enriched_description", F.coalesce("_given", "enriched_description")).drop("_given")
