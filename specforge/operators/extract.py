"""Specifications from free text and attributes, row by row.

Each field of the schema is a column of one struct, so that what follows is plain arithmetic on columns. The confidence
of a rule is fixed; hence the best hit of a field is the first non-null one among its rules, most confident first.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..fixed import ATTRIBUTE, CERTIFICATIONS, FIELDS, MATERIALS, RULES, TRUST, UNITS
from ..functions.sql import let, quote, raw, several, strip
from ..functions.text import EMPTY, marked, normalise_key_sql, token_marks_sql
from ..functions.units import canonical_sql, resolve_sql

SPEC = "struct<field:string,num:double,str:string,list:array<string>,unit:string,origin:string,confidence:double,rule:string,raw:string,start:int,stop:int>"
NONE = f"cast(null as {SPEC})"


def spec(field: str, *, num: str = "null", text: str = "null", items: str = "null", unit: str = "null", origin: str, confidence: float, rule: str, raw: str = "null", start: str = "null", stop: str = "null") -> str:
    """SQL of one value with its provenance; the confidence is held under the ceiling of its origin."""
    held = round(max(0.0, min(confidence, TRUST[origin])), 4)
    return (
        f"named_struct('field', {field}, 'num', cast({num} as double), 'str', cast({text} as string), 'list', cast({items} as array<string>), 'unit', cast({unit} as string), "
        f"'origin', '{origin}', 'confidence', {held!r}D, 'rule', '{rule}', 'raw', cast({raw} as string), 'start', cast({start} as int), 'stop', cast({stop} as int))"
    )


def usable_units(pattern: str, dimension: str) -> tuple[str, list[str]]:
    """The pattern with only those spellings in its unit group that the dimension has, and these spellings."""
    at = [m.start() for m in re.finditer(r"(?<!\\)\((?!\?)", pattern)][1]
    end = pattern.index(")", at)
    found: list[str] = []
    for spelling in pattern[at + 1 : end].split("|"):
        optional = re.search(r"(.)\?", spelling)
        forms = [spelling.replace(optional.group(0), x) for x in (optional.group(1), "")] if optional else [spelling]
        found += [x for x in forms if UNITS.get(x.lower(), ("",))[0] == dimension and x not in found]
    return pattern[: at + 1] + "|".join(found) + pattern[end:], found


def _categorical(field: str, token: str) -> str:
    return {
        "phase": f"if(lower({token}) IN ('three', '3'), '3-phase', '1-phase')", "ip_rating": f"concat('IP', {token})", "nominal_bore": f"concat('DN', {token})",
        "mounting": f"initcap({token})", "protection_class": f"replace(upper({token}), '  ', ' ')",
    }.get(field, f"if(length({token}) <= 4, upper({token}), {token})")


def needles(pattern: str, plain: bool = False) -> list[str] | None:
    """Literals of which every text that the pattern matches holds one, in lower case; none if there is no such set.

    The parsed pattern is walked: of the parts of a sequence the one with the longest literals counts, a choice needs
    those of all its branches. Only ASCII letters, digits and plain signs are trusted, whatever the case. For a plain
    text, one of ASCII alone, branches that need another character count for nothing; null if all do.
    """
    never: set[str] = set()  # stands for what no plain text matches

    def best(sets: list[set[str] | None]) -> set[str] | None:
        if any(x is never for x in sets):
            return never
        known = [x for x in sets if x]
        return max(known, key=lambda x: (min(map(len, x)), -len(x)), default=None)

    def walk(items) -> set[str] | None:
        found: list[set[str] | None] = []
        run = ""
        for op, value in [*items, (None, None)]:
            name = str(op)
            if name == "LITERAL" and value < 128:
                run += chr(value).lower()
                continue
            found += [{run}] if run else []
            run = ""
            if name == "LITERAL" and plain:
                return never
            if name == "SUBPATTERN":
                found.append(walk(value[3]))
            elif name == "BRANCH":
                branches = [b for b in map(walk, value[1]) if b is not never]
                found.append(never if not branches else set().union(*branches) if all(branches) else None)
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                found.append(walk(value[2]))
            elif name == "IN" and all(str(o) == "LITERAL" and v < 128 for o, v in value):
                found.append({chr(v).lower() for _, v in value})
        return best(found)

    literals = walk(re._parser.parse(pattern))
    return None if literals is never else sorted(literals or ())


BLANK, DIGIT = set(" \t\n\v\f\r"), set("0123456789")


def firsts(pattern: str) -> str:
    """A class of the characters with which a match in a text of ASCII alone can begin, as a pattern that looks ahead; empty if it is not known.

    Asked first, it spares the test of a word's edge at most places of a text.
    """

    def one(op, value) -> set[str] | None:
        name = str(op)
        if name == "LITERAL":
            return {chr(value)} if value < 128 else set()
        if name == "RANGE":
            return {chr(c) for c in range(value[0], min(value[1], 127) + 1)}
        return {"CATEGORY_SPACE": BLANK, "CATEGORY_DIGIT": DIGIT}.get(str(value)) if name == "CATEGORY" else None

    def walk(items) -> tuple[set[str] | None, bool]:  # the characters, and whether nothing at all may match
        found: set[str] = set()
        for op, value in items:
            name, empty = str(op), False
            if name in ("AT", "ASSERT", "ASSERT_NOT"):
                continue
            if name == "SUBPATTERN":
                own, empty = walk(value[3])
            elif name == "BRANCH":
                branches = [walk(b) for b in value[1]]
                own = None if any(b[0] is None for b in branches) else set().union(*(b[0] for b in branches))
                empty = any(b[1] for b in branches)
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                own, empty = walk(value[2])
                empty = empty or value[0] == 0
            elif name == "IN":
                parts = [one(*x) for x in value]
                own = None if any(x is None for x in parts) else set().union(*parts)
            else:
                own = one(op, value)
            if own is None:
                return None, False
            found |= own
            if not empty:
                return found, False
        return found, True

    found, empty = walk(re._parser.parse(pattern))
    return "" if not found or empty else "(?=[" + "".join(f"\\x{ord(c):02x}" for c in sorted(found)) + "])"


#: Characters outside ASCII that match an ASCII letter where case does not count, and that letter.
FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")


#: What stands for a capture's edge while a match is cut out, and for itself where a text holds it.
MARK, INSTEAD = "\u0001", "\u0002"
#: A digit, and blanks after it, and what follows: as much as the longest unit takes.
AFTER_DIGIT = r"[0-9]\s*(?=([^0-9\s].{0,%d}))" % (max(map(len, UNITS)) - 1)


def after_digits(folded: str) -> str:
    """SQL of what follows the digits of a text, and blanks after them, each behind a mark: asking for a unit behind a digit becomes plain containment in a short text."""
    return f"concat('{MARK}', array_join(regexp_extract_all({folded}, {raw(AFTER_DIGIT)}, 1), '{MARK}'))"


def rule_hit(rule: tuple, text: str = "text", folded: str = "_folded", digits: str = "_digits", ascii_only: str = "_ascii", cuttable: str = "_cuttable") -> str:
    """SQL of the first valid match of a rule, null without one.

    folded is the text in lower case: it is asked for a rule's literals before the pattern is tried. digits is what
    after_digits makes of the folded text. ascii_only tells whether the text is plain ASCII: then classes of ASCII do
    what those of all scripts do, and cost less. cuttable is the text without MARK, of the same length. A pattern is
    tried once: a replacement of the first match and all behind it leaves what stands before it, the match and its groups.
    """
    name, field, dimension, confidence, any_case, pattern = rule
    units: list[str] = []
    if dimension:
        pattern, units = usable_units(pattern, dimension)
    groups = 2 if dimension else 1
    edges = "".join(f"{MARK}${i}" for i in range(1, groups + 2))
    cut = lambda flags, ahead="": f"regexp_replace({cuttable}, {raw(f'(?{flags}){ahead}({pattern})(?s:.*)')}, '{edges}')"
    common = {"origin": "extracted", "confidence": confidence, "rule": name, "raw": "m.g0", "start": "m.at", "stop": "m.at + m.size"}
    if dimension is None:
        parts = f"'g1', {strip('p[2]')}"
        made = spec(quote(field), text=_categorical(field, "m.g1"), **common)
    else:
        known = {u.lower(): UNITS[u.lower()] for u in units}
        factors = "map(" + ", ".join(f"{quote(u)}, named_struct('by', {float(k[2])!r}D, 'plus', {float(k[3]) if dimension == 'temperature' else 0.0!r}D)" for u, k in known.items()) + ")"
        unit = next(iter(known.values()))[1]
        parts = f"'g1', try_cast(replace(p[2], ',', '') as double), 'unit', try_element_at({factors}, lower(p[3]))"
        made = spec(quote(field), num="round(m.g1 * m.unit.by + m.unit.plus, 10)", unit=quote(unit), **common)
    found = f"named_struct({parts}, 'g0', {strip(f'substring({text}, length(p[0]) + 1, length(p[1]))')}, 'size', length(p[1]), 'at', length(p[0]))"
    taken = f"split(if({ascii_only}, {cut('i' if any_case else '-i', firsts(pattern))}, {cut('iU' if any_case else 'U')}), '{MARK}')"
    hit = let(taken, "p", f"if(size(p) > 1 AND p[2] <> '', {let(found, 'm', made)}, null)")
    holds = lambda literals: "(" + " OR ".join(f"contains({folded}, {quote(n)})" for n in literals if not any(m != n and m in n for m in literals)) + ")"
    asked, other = [needles(pattern, plain=True), needles(pattern)]
    short, long = [["false"] if asked is None else [holds(asked)] if asked else [], [holds(other)] if other else []]
    if dimension and asked is not None:  # a digit, which may be one of another script, stands before a unit: asked for without the slow classes of all scripts
        spelled = sorted({u.lower() for u in units})
        if all(any(n in u for n in asked) for u in spelled if u.isascii()):  # then the units ask for as much
            short = []
        ask = [u for u in spelled if u.isascii() and not any(u != v and u.startswith(v) for v in spelled)]
        short.insert(0, "(" + " OR ".join(f"contains({digits}, {quote(MARK + u)})" for u in ask) + ")")
    if dimension:
        long.append(f"{folded} RLIKE {raw(r'[0-9[^\x00-\x7F]][\s[^\x00-\x7F]]*(?:' + '|'.join(re.escape(u.lower()) for u in units) + ')')}")
    return f"CASE WHEN if({ascii_only}, {' AND '.join(short) or 'true'}, {' AND '.join(long) or 'true'}) THEN {hit} END"


SPELLINGS = [(alias, name) for name, aliases in MATERIALS.items() for alias in aliases]


def spelling(lower: str = "_lower") -> str:
    """The place of the longest spelling of a material that stands in the text, given in lower case; the earlier entry on ties."""
    order = sorted(range(len(SPELLINGS)), key=lambda i: (-len(SPELLINGS[i][0]), i))
    return "CASE " + " ".join(f"WHEN contains({lower}, {quote(SPELLINGS[i][0])}) THEN {i}" for i in order) + " END"


def material(at: str = "_spelling") -> str:
    """The material of a spelling."""
    names, aliases = ("array(" + ", ".join(quote(x[k]) for x in SPELLINGS) + ")" for k in (1, 0))
    made = spec("'material'", text=f"get({names}, {at})", origin="extracted", confidence=0.93, rule="EXT.MATERIAL.VOCAB", raw=f"get({aliases}, {at})")
    return f"if({at} IS NULL, {NONE}, {made})"


def marks(marked_text: str = "_marks") -> str:
    """The sorted certification marks that stand as whole tokens in a text, given as token_marks_sql makes it."""
    return several({quote(c): f"contains({marked_text}, {quote(marked(c))})" for c in sorted(CERTIFICATIONS)}, "string")


def certifications(found: str = "_certified") -> str:
    made = spec("'certifications'", items=found, origin="extracted", confidence=0.9, rule="EXT.CERT.VOCAB")
    return f"if(size({found}) = 0, {NONE}, {made})"


def from_attribute(key: str, value: str) -> str:
    """A source attribute: number and unit, number alone, or text; null if blank."""
    p = raw("(?U)" + ATTRIBUTE)
    # An empty text is no number: a cast of it would make and catch an error.
    parts = f"named_struct('text', v, 'number', try_cast(nullif(replace(regexp_extract(v, {p}, 1), ',', ''), '') as double), 'unit', {strip(f'regexp_extract(v, {p}, 2)')})"
    parsed = f"named_struct('text', a.text, 'number', a.number, 'unit', a.unit, 'known', {resolve_sql('a.unit')})"
    one = lambda **k: spec(key, origin="input", confidence=1.0, rule="EXT.ATTR.STRUCTURED", raw="a.text", **k)
    choice = f"CASE WHEN coalesce(a.text, '') = '' THEN {NONE} WHEN a.number IS NOT NULL AND a.unit = '' THEN {one(num='a.number')} WHEN a.number IS NOT NULL AND a.known IS NOT NULL THEN {one(num=canonical_sql('a.number', 'a.known'), unit='a.known.unit')} ELSE {one(text='a.text')} END"
    return let(strip(value), "v", let(parts, "a", let(parsed, "a", choice)))


def settled(df: DataFrame, *names: str) -> DataFrame:
    """df with some of its columns handed through a generator of one row.

    Filters and the search for the origin of join keys do not look behind a generator. Without it, they would unfold a
    column that long expressions use many times, and planning would grow with the product of their sizes.
    """
    rest = [f"`{c}`" for c in df.columns if c not in names]
    return df.selectExpr(*rest, "inline_outer(array(named_struct(" + ", ".join(f"'{n}', {n}" for n in names) + ")))")


def extract(df: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """Adds given (attribute values in order), t (a column per field, from the text) and s (the same, merged by trust).

    Of attributes that name one field the first counts. An attribute outranks the text.
    """
    entries = f"transform(map_entries(coalesce(attributes, {EMPTY})), e -> {from_attribute(normalise_key_sql('e.key'), 'e.value')})"
    folded = f"if(octet_length(text) = length(text), lower(text), lower(translate(text, '{FOLDED[0]}', '{FOLDED[1]}'))) AS _folded"
    plain = ["octet_length(text) = length(text) AS _ascii", f"replace(text, '{MARK}', '{INSTEAD}') AS _cuttable"]
    # What is asked more than once has a column of its own: these are compiled, where a bound name would be interpreted.
    named = df.selectExpr("*", "lower(text) AS _lower", f"{token_marks_sql('text')} AS _marks", *plain, folded, f"filter({entries}, g -> g IS NOT NULL AND g.field <> '') AS _listed")
    first = named.selectExpr("*", f"{after_digits('_folded')} AS _digits", f"{spelling()} AS _spelling", f"{marks()} AS _certified", "filter(_listed, (g, i) -> NOT exists(slice(_listed, 1, i), e -> e.field = g.field)) AS given").drop("_listed")
    ordered = sorted(rules, key=lambda r: -round(min(r[3], TRUST["extracted"]), 4))
    best = {f: [rule_hit(r) for r in ordered if r[1] == f] for f in FIELDS} | {"material": [material()], "certifications": [certifications()]}
    columns = ", ".join(f"'{f}', cast({'coalesce(' + ', '.join(best[f]) + ')' if best[f] else NONE} as {SPEC})" for f in FIELDS)
    read = first.selectExpr("*", f"named_struct({columns}) AS t", "map_from_entries(transform(given, g -> struct(g.field, g))) AS _given")
    merged = ", ".join(f"'{f}', coalesce(try_element_at(_given, '{f}'), t.{f})" for f in FIELDS)
    return settled(read.selectExpr("*", f"named_struct({merged}) AS s").drop("_given", "_lower", "_folded", "_ascii", "_cuttable", "_digits", "_marks", "_spelling", "_certified"), "given", "t", "s")


def listed(fields: str = "s") -> str:
    """SQL of all values in order: fields as the rules stand, attributes alone after them, computed values last."""
    of_text = several({f"{fields}.{f}": f"t.{f} IS NOT NULL AND {fields}.{f} IS NOT NULL" for f in FIELDS}, SPEC)
    found = "CASE g.field " + " ".join(f"WHEN '{f}' THEN t.{f} IS NOT NULL" for f in FIELDS) + " ELSE false END"
    computed = several({f"{fields}.{f}": f"coalesce({fields}.{f}.origin IN ('derived', 'llm', 'default'), false)" for f in FIELDS}, SPEC)
    return f"concat({of_text}, filter(given, g -> NOT {found}), {computed})"
