"""Explanations read off the values, the ranking and the findings: nothing is asserted that the chain did not record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import AMBIGUOUS_CATEGORY, FIELDS, ORIGIN_LABELS, TRUST
from ..functions.sql import let, quote
from ..sinks.writers import display

STAGES = {
    "extract": "patterns and vocabularies read the text and the attributes", "classify": "every leaf of the taxonomy was scored", "derive": "quantities that follow from others were computed",
    "describe": "the description was composed", "validate": "the rules were checked",
}
SNIPPET = 20


def _case(of: str, values: dict) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {quote(k)} THEN {quote(v) if isinstance(v, str) else repr(v) + 'D'}" for k, v in values.items()) + " END"


def _count(*origins: str) -> str:
    return f"size(filter(specs, v -> v.origin IN ({', '.join(map(quote, origins))})))"


def trust_breakdown(enriched: DataFrame) -> DataFrame:
    """product_id, total_fields, the shares that are verifiable, computed and model-inferred, mean_confidence, completeness."""
    share = lambda *o: f"round({_count(*o)} / greatest(size(specs), 1), 4)"
    return enriched.selectExpr("product_id", "size(specs) AS total_fields", f"{share('input', 'extracted')} AS verifiable_ratio", f"{share('derived')} AS computed_ratio", f"{share('llm')} AS model_inferred_ratio", "mean_confidence", "completeness")


def field_provenance(enriched: DataFrame) -> DataFrame:
    """A row per value: how it reads, where it comes from and the evidence, by field.

    evidence is an array of (rule, detail): the rule that gave the value and, where an attribute replaced what the text
    says, MERGE.TRUST_ORDER with the value that lost. snippet is the text around the match, span its place.
    """
    loser = "CASE v.field " + " ".join(f"WHEN '{f}' THEN t.{f}" for f in FIELDS) + " END"
    spread = enriched.selectExpr("product_id", "text", "t", "inline(transform(specs, v -> named_struct('v', v)))").selectExpr("product_id", "text", "v", f"if(v.origin = 'input', {loser}, null) AS lost")
    snippet = f"if(v.start IS NULL, null, trim(substring(text, greatest(v.start - {SNIPPET}, 0) + 1, v.stop + {SNIPPET} - greatest(v.start - {SNIPPET}, 0))))"
    detail = "CASE v.origin WHEN 'input' THEN concat('given as ', v.raw) WHEN 'extracted' THEN concat('found as ', coalesce(v.raw, array_join(v.list, ', '))) WHEN 'derived' THEN 'computed from other fields' WHEN 'llm' THEN concat('proposed by the model: ', coalesce(v.raw, 'no basis given')) ELSE 'default of the category' END"
    merged = f"named_struct('rule', 'MERGE.TRUST_ORDER', 'detail', concat('outranks the ', lost.origin, ' value ', {display('lost')}, ' (', cast(lost.confidence as string), ')'))"
    evidence = f"array_compact(array(named_struct('rule', v.rule, 'detail', {detail}), if(lost IS NULL, null, {merged})))"
    return spread.selectExpr(
        "product_id", "v.field AS field", f"{display('v')} AS display", "v.num AS num", "v.unit AS unit", "v.origin AS origin", f"{_case('v.origin', ORIGIN_LABELS)} AS origin_label", f"{_case('v.origin', TRUST)} AS trust",
        "v.confidence AS confidence", "v.origin IN ('input', 'extracted') AS verifiable", "v.raw AS raw", "array(v.start, v.stop) AS span", f"{snippet} AS snippet", f"{evidence} AS evidence",
    )


def spec_rows(enriched: DataFrame) -> DataFrame:
    """The values of each record as an array, most trusted first, then by field."""
    row = f"named_struct('minus_trust', -{_case('v.origin', TRUST)}, 'field', v.field, 'value', {display('v')}, 'origin', v.origin, 'confidence', v.confidence, 'raw', coalesce(v.raw, ''))"
    return enriched.selectExpr("product_id", f"array_sort(transform(specs, v -> {row})) AS rows")


def category_reasoning(enriched: DataFrame) -> DataFrame:
    """product_id, assigned, code, path, confidence, origin, signals, penalised, margin, supporting, doubtful, alternatives."""
    return enriched.selectExpr(
        "product_id", "category.name AS assigned", "category.code AS code", "category.path AS path", "category.confidence AS confidence", "category.origin AS origin",
        "if(category.origin = 'taxonomy', slice(get(ranked, 0).matched, 1, 6), null) AS signals", "if(category.origin = 'taxonomy', get(ranked, 0).penalised, null) AS penalised",
        "if(category.origin = 'taxonomy', get(ranked, 0).score - coalesce(get(ranked, 1).score, 0.0D), null) AS margin", "array_sort(array_intersect(category.expected, transform(specs, v -> v.field))) AS supporting",
        f"category.confidence < {AMBIGUOUS_CATEGORY!r}D AS doubtful", "transform(alternatives, a -> named_struct('code', a.code, 'name', a.name, 'score', a.score, 'confidence', a.confidence, 'why', slice(a.matched, 1, 4))) AS alternatives",
    )


def reasoning_chain(enriched: DataFrame) -> DataFrame:
    """A row per stage of each record: place, stage, what it does and what it gave."""
    gave = {
        "extract": "concat(cast(size(filter(specs, v -> v.origin IN ('input', 'extracted'))) as string), ' values, ', cast(size(keywords) as string), ' keywords')", "classify": "concat(category.code, ' (', category.origin, ')')",
        "derive": "array_join(transform(filter(specs, v -> v.origin = 'derived'), v -> v.field), ', ')", "describe": "concat(cast(length(enriched_description) as string), ' characters')", "validate": "concat(validation.status, ', ', cast(size(findings) as string), ' findings')",
    }
    rows = ", ".join(f"named_struct('place', {i}, 'stage', '{k}', 'description', {quote(STAGES[k])}, 'result', {v})" for i, (k, v) in enumerate(gave.items(), 1))
    return enriched.selectExpr("product_id", f"inline(array({rows}))")


def validation_reasoning(enriched: DataFrame) -> DataFrame:
    """product_id, status, score, consistency, blocking and advisory findings, and how many checks ran."""
    return enriched.selectExpr(
        "product_id", "validation.status AS status", "validation.score AS score", "validation.consistency AS consistency", "validation.checked_rules AS checked_rules",
        "filter(findings, f -> f.severity IN ('critical', 'major')) AS blocking", "filter(findings, f -> f.severity IN ('minor', 'info')) AS advisory",
    )


def review_queue(enriched: DataFrame) -> DataFrame:
    """product_id, place, priority, field, reason, action: what a person should look at, most urgent first, then by field."""
    entry = lambda priority, field, reason, action: f"named_struct('priority', {priority}, 'field', {field}, 'reason', {reason}, 'action', {action})"
    kind = "array<struct<priority:int,field:string,reason:string,action:string>>"
    proposed = f"transform(filter(specs, v -> v.origin = 'llm'), v -> {entry('if(v.confidence < 0.6D, 2, 3)', 'v.field', quote('proposed by the model'), quote('confirm against the datasheet'))})"
    blocking = f"transform(filter(findings, f -> f.severity IN ('critical', 'major')), f -> {entry('1', 'f.field', 'f.rule', 'coalesce(f.suggestion, ' + quote('correct the source data') + ')')})"
    near = "array_join(transform(slice(alternatives, 1, 2), a -> a.name), ', ')"
    doubt = f"if(category.confidence < {AMBIGUOUS_CATEGORY!r}D, array({entry('1', quote('category'), quote('no clear winner'), let(near, 'n', 'concat(' + quote('choose among: ') + ', if(n = ' + quote('') + ', ' + quote('none') + ', n))'))}), cast(array() as {kind}))"
    queue = f"array_sort(concat(cast({proposed} as {kind}), cast({blocking} as {kind}), cast({doubt} as {kind})))"
    return enriched.selectExpr("product_id", f"{queue} AS queue").select("product_id", F.posexplode("queue").alias("at", "q")).select("product_id", (F.col("at") + 1).alias("place"), "q.*")


def summary(enriched: DataFrame) -> DataFrame:
    """product_id and a sentence: the category, how many values come from where, and the share that the source states."""
    parts = [f"if({_count(o)} > 0, concat(cast({_count(o)} as string), ' {ORIGIN_LABELS[o].lower()}'), null)" for o in ("input", "extracted", "derived", "llm")]
    share = f"cast(cast(bround(100 * {_count('input', 'extracted')} / greatest(size(specs), 1)) as int) as string)"
    some = f"concat(name, ': ', category.name, ', ', cast(size(specs) as string), ' values (', concat_ws(', ', {', '.join(parts)}), '), ', {share}, ' percent stated by the source')"
    return enriched.selectExpr("product_id", f"if(size(specs) = 0, concat(name, ': ', category.name, ', no values found'), {some}) AS summary")
