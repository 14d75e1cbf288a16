"""Unit conversion over a literal map from spellings to dimensions. A missing or unknown unit gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import AGREEMENT, UNITS
from .sql import let, quote, strip


def literal_map(dimension: str | None = None) -> str:
    """SQL of the map from spellings to dimension, unit, multiplier and offset."""
    entries = [f"{quote(alias)}, named_struct('dimension', {quote(d)}, 'unit', {quote(unit)}, 'multiplier', {m!r}D, 'offset', {o!r}D)" for alias, (d, unit, m, o) in UNITS.items() if dimension in (None, d)]
    return f"map({', '.join(entries)})"


def resolve_sql(unit: str, dimension: str | None = None) -> str:
    """dimension, unit, multiplier and offset of a spelling; null if it is unknown or of another dimension than the given one."""
    key = f"replace(replace(replace(lower({strip(unit)}), ' ', ''), '³', '3'), '^3', '3')"
    return f"try_element_at({literal_map(dimension)}, rtrim('.', {key}))"


def canonical_sql(value: str, resolved: str) -> str:
    return f"round({value} * {resolved}.multiplier + {resolved}.offset, 10)"


def agree_sql(a: str, unit_a: str, b: str, unit_b: str, tolerance: float = AGREEMENT) -> str:
    """True if two measurements of one dimension differ by no more than a share of the larger; false across dimensions."""
    near = f"(greatest(abs(v.x), abs(v.y)) = 0 OR abs(v.x - v.y) <= greatest(abs(v.x), abs(v.y)) * {tolerance!r}D)"
    values = f"named_struct('same', p.a.dimension = p.b.dimension, 'x', {canonical_sql(a, 'p.a')}, 'y', {canonical_sql(b, 'p.b')})"
    pair = f"named_struct('a', {resolve_sql(unit_a)}, 'b', {resolve_sql(unit_b)})"
    return f"coalesce({let(pair, 'p', let(values, 'v', f'v.same AND {near}'))}, false)"


def resolve(unit: Column, dimension: str | None = None) -> Column:
    key = F.replace(F.replace(F.replace(F.lower(F.regexp_replace(unit, r"(?U)^\s+|\s+$", "")), F.lit(" "), F.lit("")), F.lit("³"), F.lit("3")), F.lit("^3"), F.lit("3"))
    return F.try_element_at(F.expr(literal_map(dimension)), F.rtrim(key, F.lit(".")))


def to_canonical(value: Column, resolved: Column) -> Column:
    """The value in canonical units; null for an unknown unit."""
    return F.round(value * resolved["multiplier"] + resolved["offset"], 10)


def dimension_of(unit: Column) -> Column:
    return resolve(unit)["dimension"]


def same_dimension(a: Column, b: Column) -> Column:
    """False where a unit is unknown."""
    return F.coalesce(dimension_of(a) == dimension_of(b), F.lit(False))


def convert(value: Column, source: Column, target: Column) -> Column:
    """The value in another unit of its dimension; null if there is none."""
    a, b = resolve(source), resolve(target)
    return F.when(a["dimension"] == b["dimension"], F.round((value * a["multiplier"] + a["offset"] - b["offset"]) / b["multiplier"], 10))


def values_agree(a: Column, unit_a: Column, b: Column, unit_b: Column, tolerance: float = AGREEMENT) -> Column:
    """True if two measurements of one dimension differ by no more than a share of the larger; false across dimensions."""
    ra, rb = resolve(unit_a), resolve(unit_b)
    x, y = to_canonical(a, ra), to_canonical(b, rb)
    largest = F.greatest(F.abs(x), F.abs(y))
    return F.coalesce((ra["dimension"] == rb["dimension"]) & ((largest == 0) | (F.abs(x - y) <= largest * tolerance)), F.lit(False))
