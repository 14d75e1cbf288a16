"""Text as column expressions: keys, fingerprints, hashes, tokens, headings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import ALIASES, KEY_VALUE, KEYWORD, NUMBERED, STOPWORDS
from .sql import BLANKS, let, quote, raw, strip

ALNUM = r"([a-z0-9]+)"
EMPTY = "cast(map() as map<string,string>)"


def stripped(x: Column) -> Column:
    """x without white space at its ends, of any kind."""
    return F.btrim(x, F.lit(BLANKS))


def clean(x: Column) -> Column:
    """White space runs become a blank, those at the ends nothing; null becomes empty."""
    return F.btrim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def squash(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]", "")


def fingerprint(name: Column, category: Column) -> Column:
    return F.substring(F.sha2(F.concat(squash(name), F.lit("|"), squash(category)), 256), 1, 16)


def _json(x: str) -> str:
    """A string as JSON writes it, where only ASCII stays as it is."""
    basic = f"substring(to_json(named_struct('x', {x})), 6, length(to_json(named_struct('x', {x}))) - 6)"
    wide = "c -> CASE WHEN ascii(c) < 128 THEN c WHEN ascii(c) < 65536 THEN concat('\\\\u', lower(lpad(hex(ascii(c)), 4, '0'))) ELSE concat('\\\\u', lower(hex(55296 + shiftright(ascii(c) - 65536, 10))), '\\\\u', lower(hex(56320 + ((ascii(c) - 65536) & 1023)))) END"
    return f"CASE WHEN {x} RLIKE r'[^\\x00-\\x7F]' THEN array_join(transform(split({basic}, ''), {wide}), '') ELSE {basic} END"


def content_hash(name: str = "name", description: str = "description", attributes: str = "attributes") -> Column:
    """SHA-256 of the compact JSON of description, name and attributes with sorted keys: the identity of a record's content."""
    pairs = f"array_join(transform(sort_array(map_entries(coalesce({attributes}, {EMPTY}))), e -> concat({_json('e.key')}, ':', {_json('e.value')})), ',')"
    text = lambda x: let(strip(f"coalesce({x}, '')"), "v", _json("v"))
    return F.expr(f"sha2(concat('{{\"attributes\":{{', {pairs}, '}},\"description\":', {text(description)}, ',\"name\":', {text(name)}, '}}'), 256)")


def text_blob(name: str = "name", description: str = "description", attributes: str = "attributes") -> str:
    """SQL of name, description and the sorted `key: value` attributes, a line each; blanks are left out."""
    pairs = f"transform(sort_array(map_entries(coalesce({attributes}, {EMPTY}))), e -> concat(e.key, ': ', e.value))"
    return f"array_join(filter(concat(array({name}, {description}), {pairs}), p -> coalesce(p, '') <> ''), '\\n')"


def normalise_key_sql(key: str) -> str:
    cleaned = f"btrim(regexp_replace(lower({strip(key)}), r'[^a-z0-9]+', '_'), '_')"
    aliases = "map(" + ", ".join(f"{quote(a)}, {quote(k)}" for a, k in ALIASES.items()) + ")"
    return let(cleaned, "k", f"coalesce(try_element_at({aliases}, k), k)")


def normalise_key(key: Column) -> Column:
    cleaned = F.btrim(F.regexp_replace(F.lower(stripped(key)), r"[^a-z0-9]+", "_"), F.lit("_"))
    aliases = F.expr("map(" + ", ".join(f"{quote(a)}, {quote(k)}" for a, k in ALIASES.items()) + ")")
    return F.coalesce(F.try_element_at(aliases, cleaned), cleaned)


def token_marks_sql(text: str) -> str:
    """Lower-cased text with marks around its alphanumeric runs: whole-token search becomes plain containment."""
    return f"regexp_replace(lower(coalesce({text}, '')), r'{ALNUM}', '\\u0001$1\\u0002')"


def marked(term: str) -> str:
    return re.sub(ALNUM, "\u0001\\1\u0002", term.lower())


def keywords_sql(text: str, most: int = 12) -> str:
    """The most frequent tokens, ties in alphabetical order. Tokens are sorted once and counted by where each begins."""
    stop = ", ".join(map(quote, STOPWORDS))
    tokens = f"sort_array(filter(regexp_extract_all(lower({text}), {raw('(' + KEYWORD + ')')}, 1), t -> t NOT IN ({stop})))"
    begins = "filter(sequence(0, size(st) - 1), i -> i = 0 OR get(st, i) <> get(st, i - 1))"
    counted = "transform(b, (i, j) -> named_struct('n', i - coalesce(get(b, j + 1), size(st)), 'token', get(st, i)))"
    top = f"transform(slice(sort_array({let(begins, 'b', counted)}), 1, {most}), x -> x.token)"
    return let(tokens, "st", f"if(size(st) = 0, cast(array() as array<string>), {top})")


def key_value(line: Column) -> Column:
    """key and value of a `Key: value` line; null for other lines."""
    key, value = stripped(F.regexp_extract(line, KEY_VALUE, 1)), stripped(F.regexp_extract(line, KEY_VALUE, 2))
    return F.when((key != "") & (F.length(value) < 120), F.struct(key.alias("key"), value.alias("value")))


def key_value_map(lines: Column) -> Column:
    """The pairs of an array of lines as a map. Of keys that differ in case alone the first counts."""
    pairs = F.filter(F.transform(lines, key_value), lambda p: p.isNotNull())
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda e: F.lower(e["key"]) == F.lower(p["key"])))
    return F.map_from_entries(first)


def is_heading(line: Column) -> Column:
    letters = F.length(F.regexp_replace(line, r"\P{L}", ""))
    capitals = F.length(F.regexp_replace(line, r"\P{Lu}", ""))
    shouted = (letters > 0) & (capitals > letters * 0.75)
    return F.length(line).between(4, 90) & ~line.rlike(r"[.,;:]$") & (line.rlike("(?U)" + NUMBERED) | shouted)
