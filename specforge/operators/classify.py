"""Scored classification against the taxonomy, row by row: the leaves are one literal, nothing is shuffled."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

from ..fixed import FALLBACK, TAXONOMY, TRUST, WEIGHTS
from ..functions.sql import let, quote, raw, strip, words
from ..functions.text import ALNUM, marked, token_marks_sql
from .extract import settled

LEAF = "struct<code:string,name:string,path:array<string>,strong:array<string>,weak:array<string>,negative:array<string>,expected:array<string>,required:array<string>>"


def leaves(taxonomy: list[dict] = TAXONOMY) -> str:
    """SQL of the leaves as one constant; terms carry their token marks."""
    rows = [{"code": x["code"], "name": x["path"][-1], **{k: x[k] for k in ("path", "expected", "required")}, **{k: [marked(t) for t in x[k]] for k in ("strong", "weak", "negative")}} for x in taxonomy]
    return f"from_json({quote(json.dumps(rows))}, 'array<{LEAF}>')"


def _points(kind: str, in_name: float, in_description: float) -> str:
    # A leaf of which no term can stand in the texts gets no points: i is its place in _known.
    return f"if(get(_known, i), aggregate(x.{kind}, 0.0D, (n, t) -> n + CASE WHEN contains(_n, t) THEN {in_name!r}D WHEN contains(_d, t) THEN {in_description!r}D ELSE 0.0D END), 0.0D)"


def known(taxonomy: list[dict]) -> str:
    """SQL of an array that tells of each leaf whether a term of it may stand in the texts: no term does whose longest token is none of theirs."""

    def one(leaf: dict) -> str:
        found = longest(leaf)
        return "true" if not all(found) else f"arrays_overlap(_w, {words(sorted(set(found)))})"

    return "array(" + ", ".join(map(one, taxonomy)) + ")"


def longest(leaf: dict) -> list[str]:
    """The longest token of each term of a leaf, empty for a term without one."""
    return [(sorted(re.findall(ALNUM, t.lower()), key=len) or [""])[-1] for k in ("strong", "weak", "negative") for t in leaf[k]]


def telling(taxonomy: list[dict]) -> list[str]:
    """The tokens that known asks for: only these are kept of the texts."""
    return sorted({t for x in taxonomy for t in longest(x)} - {""}) or [""]


def typical(taxonomy: list[dict]) -> str:
    """SQL of an array that tells of each leaf how many of its expected fields a record has."""
    has = lambda f: f"if(coalesce(array_contains(_f, {quote(f)}), false), 1, 0)"
    return "array(" + ", ".join(" + ".join(["0", *map(has, dict.fromkeys(x["expected"]))]) for x in taxonomy) + ")"


def _matched() -> str:
    """The signals of a leaf x: terms and where they stand, then the specifications that are typical of it."""
    plain = "translate(t, '\\u0001\\u0002', '')"
    terms = "filter(transform(concat(x.strong, x.weak), t -> CASE WHEN contains(_n, t) THEN concat('name:', chr(39), {0}, chr(39)) WHEN contains(_d, t) THEN concat('description:', chr(39), {0}, chr(39)) END), m -> m IS NOT NULL)".format(plain)
    typical = let("sort_array(array_intersect(_f, x.expected))", "o", "if(size(o) = 0, cast(array() as array<string>), array(concat('specs:[', array_join(transform(o, f -> concat(chr(39), f, chr(39))), ', '), ']')))")
    return f"concat(if(get(_known, r.i), {terms}, cast(array() as array<string>)), {typical})"


def classify(df: DataFrame, taxonomy: list[dict] = TAXONOMY) -> DataFrame:
    """Adds ranked (code, name, score, confidence, matched, penalised; at most five), category and alternatives.

    A category that the source names exactly is taken as it is. Otherwise the best leaf by score, then code; the
    fallback where none scores. category has code, name, path, origin, confidence, expected, required and rule.
    """
    w = WEIGHTS
    score = f"{_points('strong', w['name_strong'], w['desc_strong'])} + {_points('weak', w['name_weak'], w['desc_weak'])} + {_points('negative', w['negative'], w['negative'])} + get(_typical, i) * {w['spec']!r}D"
    fields = "transform(specs, v -> v.field)"
    seen = df.selectExpr("*", f"{token_marks_sql('name')} AS _n", f"{token_marks_sql('description')} AS _d", f"{fields} AS _f", f"{strip('raw_category')} AS _own")
    marks = raw("\u0001" + ALNUM)
    words_of = f"filter(concat(regexp_extract_all(_n, {marks}, 1), regexp_extract_all(_d, {marks}, 1)), w -> w IN ({', '.join(map(quote, telling(taxonomy)))}))"
    both = seen.selectExpr("*", f"{words_of} AS _w").selectExpr("*", f"{known(taxonomy)} AS _known", f"{typical(taxonomy)} AS _typical")
    scored = f"filter(transform({leaves(taxonomy)}, (x, i) -> named_struct('minus', -({score}), 'code', x.code, 'i', i)), r -> r.minus < 0)"
    placed = both.selectExpr("*", f"sort_array({scored}) AS _all")
    top, second = "-get(_all, 0).minus", "coalesce(-get(_all, 1).minus, 0.0D)"
    first = f"least(0.99D, least({top} / greatest({top}, 1.0D), 1.0D) * 0.55D + ({top} - {second}) / {top} * 0.45D)"
    other = f"least(0.85D, -r.minus / greatest({top}, 1.0D) * 0.6D)"
    penalised = "transform(filter(if(get(_known, r.i), x.negative, cast(array() as array<string>)), t -> contains(_n, t) OR contains(_d, t)), t -> translate(t, '\\u0001\\u0002', ''))"
    # Leaves are named by their places and looked up in the constant: carried along, they would be copied into every row.
    leaf = lambda at: f"get({leaves(taxonomy)}, {at})"
    one = f"named_struct('code', r.code, 'name', {leaf('r.i')}.name, 'score', -r.minus, 'confidence', round(if(i = 0, {first}, {other}), 4), 'matched', {let(leaf('r.i'), 'x', _matched())}, 'penalised', {let(leaf('r.i'), 'x', penalised)})"
    given = f"if(coalesce(_own, '') = '', null, get(filter({leaves(taxonomy)}, x -> lower(x.name) = lower(_own) OR x.code = upper(_own)), 0))"
    ranked = f"transform(slice(_all, 1, 5), (r, i) -> {one}) AS ranked"
    found = placed.selectExpr("*", f"{given} AS _given")
    fallback = f"named_struct('code', {quote(FALLBACK[0])}, 'name', {quote(FALLBACK[1][-1])}, 'path', {words(FALLBACK[1])}, " + ", ".join(f"'{k}', {words([])}" for k in ("strong", "weak", "negative", "expected", "required")) + ")"
    leafed = found.selectExpr("*", f"coalesce(_given, {leaf('get(_all, 0).i')}, cast({fallback} as {LEAF})) AS _leaf")
    origin = "CASE WHEN _given IS NOT NULL THEN 'input' WHEN size(_all) > 0 THEN 'taxonomy' ELSE 'default' END"
    confidence = f"CASE WHEN _given IS NOT NULL THEN 1.0D WHEN size(_all) > 0 THEN least(round({first}, 4), {TRUST['taxonomy']!r}D) ELSE 0.2D END"
    rule = "CASE WHEN _given IS NOT NULL THEN 'TAX.SOURCE_PROVIDED' ELSE concat('TAX.', _leaf.code) END"
    category = f"named_struct('code', _leaf.code, 'name', _leaf.name, 'path', _leaf.path, 'origin', {origin}, 'confidence', {confidence}, 'expected', _leaf.expected, 'required', _leaf.required, 'rule', {rule})"
    named = settled(leafed.selectExpr("*", f"{category} AS category", "_given IS NOT NULL AS _named").drop("_own", "_w", "_typical", "_given", "_leaf"), "category")
    # What was weighed stays outside: those who ask for the category alone do not pay for it.
    weighed = named.selectExpr("*", ranked).selectExpr("*", "if(_named, slice(ranked, 1, 0), slice(ranked, 2, 3)) AS alternatives")
    order = [c for c in weighed.columns if c not in ("_n", "_d", "_f", "_known", "_all", "_named", "ranked", "category", "alternatives")]
    return weighed.select(*order, "ranked", "category", "alternatives")
