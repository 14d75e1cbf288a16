"""Validation rules as row-local expressions, with scores and completeness."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from .. import fixed as fx
from ..functions.sql import let, quote, strip
from .derive import phase_factor

FINDING = "struct<rule:string,severity:string,field:string,observed:double,expected:string,suggestion:string>"


def finding(rule: str, severity: str, field: str, observed: str = "null", expected: str = "null", suggestion: str = "null") -> str:
    return f"named_struct('rule', {rule}, 'severity', {severity}, 'field', {field}, 'observed', cast({observed} as double), 'expected', cast({expected} as string), 'suggestion', cast({suggestion} as string))"


def _fixed(rule: str, severity: str, field: str, **k: str) -> str:
    return finding(quote(rule), quote(severity), quote(field), **k)


def identity() -> list[str]:
    name = strip("coalesce(name, '')")
    return [
        f"CASE WHEN {name} = '' THEN {_fixed('VAL.ID.NAME_MISSING', 'critical', 'name')} WHEN length({name}) < 3 THEN {_fixed('VAL.ID.NAME_SHORT', 'major', 'name', suggestion=quote('name the kind of product and its model'))} END",
        f"CASE WHEN category IS NULL THEN {_fixed('VAL.ID.NO_CATEGORY', 'major', 'category')} WHEN category.confidence < {fx.WEAK_CATEGORY!r}D THEN {_fixed('VAL.ID.WEAK_CATEGORY', 'minor', 'category', observed='category.confidence', expected=quote(f'>= {fx.WEAK_CATEGORY}'), suggestion=quote('say the kind of product in the name or description'))} END",
    ]


def _slip(lo: str, hi: str, v: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} * {factor!r}D BETWEEN {lo} AND {hi} THEN '{label}'" for factor, label in fx.UNIT_SLIPS) + " END"


def ranges() -> list[str]:
    """A finding per measured field of the schema that is negative, or outside its category's range or the one for all."""
    found = []
    for f in fx.FIELDS:
        v = f"s.{f}.num"
        own = [(c, r[f]) for c, r in fx.CATEGORY_RANGES.items() if f in r]
        lo, hi = fx.GLOBAL_RANGES.get(f, (None, None))
        pick = lambda i, rest: f"CASE category.code {' '.join(f'WHEN {quote(c)} THEN {r[i]!r}D' for c, r in own)} ELSE {rest} END" if own else rest  # noqa: E731, B023
        low, high = pick(0, f"{lo!r}D" if lo is not None else "null"), pick(1, f"{hi!r}D" if hi is not None else "null")
        case = f"WHEN {v} < 0 THEN {_fixed(f'VAL.RANGE.NEGATIVE.{f.upper()}', 'critical', f, observed=v, expected=quote('> 0'))}" if f != "max_temperature" else ""
        if lo is not None:
            severity = f"if(category.code IN ({', '.join(quote(c) for c, _ in own)}), 'major', 'minor')" if own else "'minor'"
            wide = finding(quote(f"VAL.RANGE.{f.upper()}"), severity, quote(f), v, f"concat(cast({low} as string), ' - ', cast({high} as string))", _slip(low, high, v))
            case += f" WHEN NOT {v} BETWEEN {low} AND {high} THEN {wide}"
        if case:
            found.append(f"CASE {case} END")
    return found


def voltage() -> str:
    v, all_ = "s.voltage.num", "array(" + ", ".join(f"{float(x)!r}D" for x in fx.STANDARD_VOLTAGES) + ")"
    near = " OR ".join(f"abs({v} - {float(x)!r}D) / {float(x)!r}D <= {fx.VOLTAGE_TOLERANCE!r}D" for x in fx.STANDARD_VOLTAGES)
    nearest = f"cast(cast(array_min(transform({all_}, (x, i) -> named_struct('apart', abs(x - {v}), 'i', i, 'x', x))).x as int) as string)"
    return f"CASE WHEN {v} > {fx.LOWEST_MAINS!r}D AND NOT ({near}) THEN {_fixed('VAL.RANGE.NONSTANDARD_VOLTAGE', 'minor', 'voltage', observed=v, expected=nearest, suggestion=quote('verify against the nameplate'))} END"


def coherence() -> list[str]:
    p, v, i, f, n, t = (f"s.{x}.num" for x in ("power", "voltage", "current", "frequency", "rotational_speed", "torque"))
    factor = f"if({v} > 0 AND {i} > 0, {p} / ({v} * {i} * {phase_factor()}), null)"
    ratio = f"if({n} > 0 AND {t} > 0, {p} / ({t} * ({n} * {2 * math.pi!r}D / 60.0D)), null)"
    box = "s.length.num * s.width.num * s.height.num"
    density = f"if({box} > 0, s.weight.num * 1e6D / ({box}), null)"
    speeds = "array(" + ", ".join(f"{float(x)!r}D" for x in fx.SYNCHRONOUS_SPEEDS) + ")"
    nearest = f"array_min(transform({speeds}, (x, k) -> named_struct('apart', abs(x - {n}), 'k', k, 'x', x))).x"
    (low_f, high_f), (low_r, high_r), (low_d, high_d), (low_s, high_s) = fx.POWER_FACTOR_RANGE, fx.TORQUE_RATIO_RANGE, fx.DENSITY_RANGE, fx.SLIP_RANGE
    return [
        let(factor, "r", f"CASE WHEN r > {high_f!r}D THEN {_fixed('VAL.COH.POWER_TOO_HIGH', 'major', 'power', observed='r', expected=quote(f'<= {high_f}'), suggestion=quote('the power may be an input figure, or the current one phase'))} WHEN r < {low_f!r}D THEN {_fixed('VAL.COH.POWER_TOO_LOW', 'minor', 'current', observed='r', expected=quote(f'>= {low_f}'), suggestion=quote('the current may include inrush'))} END"),
        f"CASE WHEN {f} IN (50.0D, 60.0D) AND {n} > 0 THEN {let(nearest, 'z', f'CASE WHEN NOT {n} BETWEEN z * {low_s!r}D AND z * {high_s!r}D THEN {_fixed("VAL.COH.SPEED_VS_FREQ", "minor", "rotational_speed", observed=n, expected="concat(" + quote("near ") + ", cast(cast(z as int) as string))")} END')} END",
        let(ratio, "r", f"CASE WHEN r > {high_r!r}D OR r < {low_r!r}D THEN {_fixed('VAL.COH.POWER_TORQUE_SPEED', 'major', 'torque', observed='r', expected=quote(f'{low_r} - {high_r}'), suggestion=quote('the torque may be a peak figure'))} END"),
        f"CASE WHEN s.width.num > s.diameter.num * {fx.WIDEST_ASPECT!r}D THEN {_fixed('VAL.COH.ASPECT_RATIO', 'minor', 'width', observed='s.width.num', suggestion=quote('check that both have one unit'))} END",
        let(density, "r", f"CASE WHEN r > {high_d!r}D OR r < {low_d!r}D THEN {_fixed('VAL.COH.DENSITY', 'minor', 'weight', observed='r', expected=quote(f'{low_d} - {high_d}'))} END"),
    ]


def confidence() -> list[str]:
    count = lambda test: f"size(filter(specs, v -> {test}))"
    return [
        let(count("v.origin = 'llm'"), "c", f"CASE WHEN c > 0 THEN {_fixed('VAL.CONF.LLM_INFERRED', 'info', 'specifications', observed='c', suggestion=quote('confirm against a datasheet'))} END"),
        let(count(f"v.confidence < {fx.LOW_CONFIDENCE!r}D"), "c", f"CASE WHEN c > 0 THEN {_fixed('VAL.CONF.LOW', 'minor', 'specifications', observed='c')} END"),
    ]


def penalties(test: str = "true") -> str:
    """SQL of one minus the penalties of the findings that pass a test, within 0 and 1."""
    case = "CASE f.severity " + " ".join(f"WHEN '{k}' THEN {v!r}D" for k, v in fx.PENALTY.items()) + " ELSE 0.0D END"
    return f"round(greatest(0.0D, least(1.0D, aggregate(filter(findings, f -> {test}), 1.0D, (n, f) -> n - {case}))), 4)"


def validate(df: DataFrame, strict: bool = False) -> DataFrame:
    """Adds findings, validation (is_valid, status, score, consistency, counts, checked_rules), completeness, mean_confidence."""
    fields = "transform(specs, v -> v.field)"
    single = [*identity(), *ranges(), voltage(), *coherence(), *confidence()]
    missing = f"transform(array_except(category.required, {fields}), f -> {finding('concat(' + quote('VAL.REQ.') + ', upper(f))', quote('major'), 'f', suggestion=quote('add it to the source data'))})"
    gaps = let(f"array_except(array_except(category.expected, category.required), {fields})", "g", f"if(size(g) > 0, array({_fixed('VAL.REQ.EXPECTED_GAPS', 'minor', 'specifications', observed='size(g)', expected='array_join(g, ' + quote(',') + ')')}), cast(array() as array<{FINDING}>))")
    negative = f"transform(filter(given, g -> g.num < 0 AND g.field NOT IN ({', '.join(map(quote, fx.FIELDS))})), g -> {finding('concat(' + quote('VAL.RANGE.NEGATIVE.') + ', upper(g.field))', quote('critical'), 'g.field', 'g.num', quote('> 0'))})"
    cast = lambda x: f"cast({x} as {FINDING})"
    # _single stands in a column of its own, named twice and so not unfolded: under the filter all its tests would be interpreted.
    parts = ["filter(_single, f -> f IS NOT NULL AND size(_single) > 0)", f"coalesce({missing}, cast(array() as array<{FINDING}>))", f"coalesce({gaps}, cast(array() as array<{FINDING}>))", negative]
    df = df.selectExpr("*", f"array({', '.join(map(cast, single))}) AS _single").selectExpr("*", f"concat({', '.join(parts)}) AS findings").drop("_single")
    count = lambda kind: f"size(filter(findings, f -> f.severity = '{kind}'))"
    blocking = " AND ".join(f"{count(k)} = 0" for k in ("critical", "major", *(["minor"] if strict else [])))
    own = "CASE category.code " + " ".join(f"WHEN {quote(c)} THEN {len(r)}" for c, r in fx.CATEGORY_RANGES.items()) + " ELSE 0 END"
    counts = ", ".join(f"'{k}', {count(k)}" for k in fx.PENALTY)
    report = f"named_struct('is_valid', {blocking}, 'status', if({blocking}, 'valid', 'invalid'), 'score', {penalties()}, 'consistency', {penalties('startswith(f.rule, ' + quote('VAL.COH.') + ')')}, {counts}, 'checked_rules', {fx.BASE_RULES} + coalesce(size(category.required), 0) + {own})"
    filled = "1 + if(coalesce(enriched_description, '') = '', 0, 1) + if(category IS NULL, 0, 1) + if(size(keywords) > 0, 1, 0) + size(specs)"
    held = "if(category IS NULL, transform(specs, v -> v.confidence), concat(transform(specs, v -> v.confidence), array(category.confidence)))"
    # In whole ten-thousandths: the mean does not depend on the order of a sum.
    total = "aggregate(c, 0L, (n, x) -> n + cast(round(x * 10000.0D) as bigint))"
    mean = let(held, "c", f"if(size(c) = 0, 0.0D, cast((2 * {total} + size(c)) div (2 * size(c)) as double) / 10000.0D)")
    return df.selectExpr("*", f"{report} AS validation", f"round(({filled}) / (4 + size(specs)), 4) AS completeness", f"{mean} AS mean_confidence")
