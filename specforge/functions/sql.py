"""Building blocks of SQL text. Long expressions are written as text: they are parsed once, where a tree of columns takes a call a node."""

from __future__ import annotations


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def raw(pattern: str) -> str:
    """A pattern as a raw literal."""
    return 'r"' + pattern + '"' if "'" in pattern or "\\'" in pattern else "r'" + pattern + "'"


def let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def words(terms: list[str]) -> str:
    return "cast(array(" + ", ".join(map(quote, terms)) + ") as array<string>)"


#: What Unicode calls white space. Cutting these characters off does what `(?U)^\\s+|\\s+$` does, without trying a pattern at every place.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(x: str) -> str:
    """x without white space at its ends, of any kind."""
    return f"btrim({x}, '{''.join(f'\\u{ord(c):04x}' for c in BLANKS)}')"


def several(items: dict[str, str], kind: str) -> str:
    """SQL of an array of those values whose condition holds, in order; items are conditions by value.

    A filter over an array would evaluate all values and conditions in the interpreter; this is compiled.
    """
    none = f"cast(array() as array<{kind}>)"
    return "flatten(array(" + ", ".join(f"if({test}, array({value}), {none})" for value, test in items.items()) + "))"


def general(value: str) -> str:
    """A number with six significant digits and no trailing zeros; very large and small ones with an exponent."""
    zeros = lambda x: f"regexp_replace({x}, r'\\.?0+$', '')"
    spelled = f"CASE WHEN try_cast(substring_index(e, 'e', -1) as int) BETWEEN -4 AND 5 THEN {zeros('format_string(\'%.9f\', try_cast(e as double))')} ELSE concat({zeros('substring_index(e, \'e\', 1)')}, 'e', substring_index(e, 'e', -1)) END"
    whole = f"abs({value}) < 1e6D AND {value} = floor({value})"
    return f"CASE WHEN {value} IS NULL THEN null WHEN {whole} THEN cast(cast({value} as bigint) as string) ELSE {let(f"format_string('%.5e', {value})", 'e', spelled)} END"


def measured(value: str, unit: str) -> str:
    """A measurement without float noise: whole numbers in full, others with six significant digits."""
    number = f"CASE WHEN {value} = floor({value}) AND abs({value}) < 1e15 THEN cast(cast({value} as bigint) as string) ELSE {general(value)} END"
    return f"trim(concat_ws(' ', {number}, {unit}))"
