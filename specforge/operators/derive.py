"""Quantities that physics implies, and a description from a template."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..fixed import ASSUMED_EFFICIENCY, ASSUMED_POWER_FACTOR, DESCRIBED, FIELDS, SLIP_RANGE, SYNCHRONOUS_50, SYNCHRONOUS_60
from ..functions.sql import general, let, several, strip
from .extract import listed, spec


def three_phase(s: str = "s") -> str:
    return f"coalesce(startswith(coalesce({s}.phase.str, cast({s}.phase.num as string)), '3'), false)"


def phase_factor(s: str = "s") -> str:
    return f"if({three_phase(s)}, {math.sqrt(3)!r}D, 1.0D)"


def near_synchronous(speed: str, speeds: list[int]) -> str:
    low, high = SLIP_RANGE
    return "(" + " OR ".join(f"{speed} BETWEEN {x} * {low!r}D AND {x} * {high!r}D" for x in speeds) + ")"


def derive(df: DataFrame) -> DataFrame:
    """s with current, torque and frequency where they are absent and implied, specs anew, and extra_attributes."""
    p, v, n = "s.power.num", "s.voltage.num", "s.rotational_speed.num"
    amps = f"round({p} / ({v} * {phase_factor()} * {ASSUMED_POWER_FACTOR!r}D * {ASSUMED_EFFICIENCY!r}D), 2)"
    turning = f"round({p} / ({n} * {2 * math.pi!r}D / 60.0D), 2)"
    hertz = f"CASE WHEN {near_synchronous(n, SYNCHRONOUS_50)} THEN 50.0D WHEN {near_synchronous(n, SYNCHRONOUS_60)} THEN 60.0D END"
    made = {
        "current": f"if(s.current IS NULL AND {p} IS NOT NULL AND {v} > 0, {spec(chr(39) + 'current' + chr(39), num=amps, unit=chr(39) + 'A' + chr(39), origin='derived', confidence=0.7, rule='DER.CURRENT.FROM_POWER')}, s.current)",
        "torque": f"if(s.torque IS NULL AND {p} IS NOT NULL AND {n} > 0, {spec(chr(39) + 'torque' + chr(39), num=turning, unit=chr(39) + 'Nm' + chr(39), origin='derived', confidence=0.72, rule='DER.TORQUE.FROM_POWER_SPEED')}, s.torque)",
        "frequency": let(hertz, "h", f"if(s.frequency IS NULL AND h IS NOT NULL, {spec(chr(39) + 'frequency' + chr(39), num='h', unit=chr(39) + 'Hz' + chr(39), origin='derived', confidence=0.6, rule='DER.FREQ.FROM_SPEED')}, s.frequency)"),
    }
    columns = ", ".join(f"'{f}', {made.get(f, f's.{f}')}" for f in FIELDS)
    washdown = "if(length(s.ip_rating.str) = 4 AND try_cast(substring(s.ip_rating.str, 4, 1) as int) >= 5, array('Suitable for washdown environments'), cast(array() as array<string>))"
    rest = [f"`{c}`" for c in df.columns if c not in ("s", "specs")]
    found = df.selectExpr(*rest, f"named_struct({columns}) AS s", f"{washdown} AS extra_attributes")
    return found.selectExpr("*", f"{listed()} AS specs")


def describe(df: DataFrame) -> DataFrame:
    """Adds enriched_description: the category and up to four specifications, then the source's own text."""

    def bit(key: str) -> tuple[str, str]:
        label = key.replace("_", " ")
        plain = f"coalesce(s.{key}.str, array_join(s.{key}.list, ', '), cast(s.{key}.num as string))"
        told = f"if(s.{key}.num IS NOT NULL AND s.{key}.unit IS NOT NULL, concat('{label} of ', {general(f's.{key}.num')}, ' ', s.{key}.unit), concat('{label} ', {plain}))"
        return told, f"s.{key} IS NOT NULL AND (s.{key}.num IS NOT NULL OR s.{key}.str IS NOT NULL OR s.{key}.list IS NOT NULL)"

    bits = f"slice({several(dict(map(bit, DESCRIBED)), 'string')}, 1, 4)"
    rated = "CASE size(_bits) WHEN 0 THEN '' WHEN 1 THEN concat(' rated at  ', _bits[0]) ELSE concat(' rated at ', array_join(slice(_bits, 1, size(_bits) - 1), ', '), ' and ', element_at(_bits, -1)) END"
    own = f"if(coalesce(description, '') = '', '', concat(' ', rtrim('.', {strip('description')}), '.'))"
    sentence = f"concat(coalesce(name, ''), ' is a ', lower(category.name), {rated}, '.', {own})"
    return df.selectExpr("*", f"{bits} AS _bits").selectExpr("*", f"{sentence} AS enriched_description").drop("_bits")
