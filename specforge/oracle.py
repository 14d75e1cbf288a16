"""The catalogue queries as SQL, for comparison: one chain of common table expressions over the part table."""

from __future__ import annotations

import math

from .fixed import CATEGORY_RANGES, CERTIFICATIONS, DESCRIBED, FALLBACK, FIELDS, GLOBAL_RANGES, HTML_SITE, KEYWORD, MATERIALS, NUMBERED, PENALTY, RULES, STANDARD_VOLTAGES, STOPWORDS, SYNCHRONOUS_50, SYNCHRONOUS_60, SYNCHRONOUS_SPEEDS, TAXONOMY, TRUST, UNITS, WEIGHTS
from .functions.text import marked
from .sources.catalog import ATTRIBUTES, TRUTH, catalog_sql, truth_columns


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _re2(pattern: str, any_case: bool) -> str:
    """The pattern without lookarounds, which this dialect lacks."""
    for size in ("frame ", "frame: ", "frame size ", "frame size: "):
        pattern = pattern.replace(f"(?<!{size})", "")
    pattern = pattern.replace(r"\b(?![-\w])", r"(?:$|[^-\w])").replace(r"(?!\w)", "").replace(r"(?!\d)", "")
    return q(("(?i)" if any_case else "") + pattern)


def _hit(index: int) -> str:
    rule, field, dimension, confidence, any_case, pattern = RULES[index]
    p = _re2(pattern, any_case)
    head = f"product_id, {q(rule)} AS rule, {q(field)} AS field, CAST({min(confidence, TRUST['extracted'])} AS DOUBLE) AS confidence, {index} AS ord"
    if dimension is None:
        token = "trim(m)"
        text = {
            "phase": f"CASE WHEN lower({token}) IN ('three', '3') THEN '3-phase' ELSE '1-phase' END", "ip_rating": f"'IP' || {token}", "nominal_bore": f"'DN' || {token}",
            "mounting": f"array_to_string(list_transform(string_split({token}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')", "protection_class": f"replace(upper({token}), '  ', ' ')",
        }.get(field, f"CASE WHEN length({token}) <= 4 THEN upper({token}) ELSE {token} END")
        return f"SELECT {head}, CAST(NULL AS DOUBLE) AS num, {text} AS str, CAST(NULL AS VARCHAR) AS unit FROM (SELECT product_id, regexp_extract(text, {p}, 1) AS m FROM txt) WHERE m <> ''"
    text = "regexp_replace(text, '(?i)(frame:? |frame size:? )-?[0-9.,]+', '', 'g')" if rule == "EXT.VOLUME.BARE" else "text"
    key = "rtrim(replace(replace(replace(lower(trim(u)), ' ', ''), '³', '3'), '^3', '3'), '.')"
    return f"""SELECT {head}, num, CAST(NULL AS VARCHAR) AS str, unit FROM (
  SELECT m.product_id, round(TRY_CAST(replace(m.n, ',', '') AS DOUBLE) * d.multiplier + d.shift, 10) AS num, d.unit, row_number() OVER (PARTITION BY m.product_id ORDER BY m.i) AS rn
  FROM (SELECT product_id, unnest(regexp_extract_all({text}, {p}, 1)) AS n, unnest(regexp_extract_all({text}, {p}, 2)) AS u, generate_subscripts(regexp_extract_all({text}, {p}, 1), 1) AS i FROM txt) m
  JOIN units d ON d.alias = {key} AND d.dimension = {q(dimension)}) WHERE rn = 1"""


def _values(rows) -> str:
    cell = lambda x: q(x) if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x)
    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def _numbers(xs) -> str:
    return "[" + ", ".join(f"CAST({float(x)!r} AS DOUBLE)" for x in xs) + "]"


def _near(speeds) -> str:
    return f"len(list_filter({_numbers(speeds)}, lambda s: n >= s * 0.9::DOUBLE AND n <= s * 1.02::DOUBLE)) > 0"


_SPELLINGS = [(name, alias) for name, aliases in MATERIALS.items() for alias in aliases]
_MARK = "regexp_replace(lower({}), '([a-z0-9]+)', chr(1) || '\\1' || chr(2), 'g')"
_TERMS = [(x["code"], marked(t), WEIGHTS[a], WEIGHTS[b]) for x in TAXONOMY for kind, a, b in (("strong", "name_strong", "desc_strong"), ("weak", "name_weak", "desc_weak"), ("negative", "negative", "negative")) for t in x[kind]]
_ROOT3 = repr(math.sqrt(3))
_TURN = repr(2 * math.pi)

CATALOG = f"""WITH raw AS ({catalog_sql("part", False)}),
txt AS (SELECT *, replace(concat_ws(chr(10), name, description, {", ".join(f"'{k}: ' || {c}" for k, c in ATTRIBUTES.items())}), chr(160), ' ') AS text FROM raw),
units(alias, dimension, unit, multiplier, shift) AS ({_values((a, d, u, float(m), float(o)) for a, (d, u, m, o) in UNITS.items())}),
hits AS ({" UNION ALL ".join(_hit(i) for i in range(len(RULES)))}
 UNION ALL SELECT product_id, 'EXT.MATERIAL.VOCAB', 'material', 0.93::DOUBLE, 100, NULL, name, NULL FROM (
   SELECT t.product_id, m.name, row_number() OVER (PARTITION BY t.product_id ORDER BY length(m.alias) DESC, m.i) AS rn
   FROM txt t JOIN ({_values((i, n, a) for i, (n, a) in enumerate(_SPELLINGS))}) m(i, name, alias) ON contains(lower(t.text), m.alias)) WHERE rn = 1
 UNION ALL SELECT t.product_id, 'EXT.CERT.VOCAB', 'certifications', 0.9::DOUBLE, 101, NULL, string_agg(c.name, ',' ORDER BY c.name), NULL
   FROM (SELECT product_id, {_MARK.format("text")} AS m FROM txt) t JOIN ({_values((c, marked(c)) for c in CERTIFICATIONS)}) c(name, mark) ON contains(t.m, c.mark) GROUP BY t.product_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, field ORDER BY confidence DESC, ord) AS rn FROM hits) WHERE rn = 1),
attributes AS (
  SELECT product_id, 'brand' AS field, CAST(NULL AS DOUBLE) AS num, trim(a_brand) AS str, CAST(NULL AS VARCHAR) AS unit FROM raw WHERE a_brand IS NOT NULL
  UNION ALL SELECT product_id, 'power', CAST(regexp_extract(a_power, '(\\d+) kW', 1) AS DOUBLE) * 1000, NULL, 'W' FROM raw WHERE a_power IS NOT NULL
  UNION ALL SELECT product_id, 'weight', CAST(regexp_extract(a_weight, '-?\\d+') AS DOUBLE), NULL, CASE WHEN contains(a_weight, 'kg') THEN 'kg' END FROM raw WHERE a_weight IS NOT NULL
  UNION ALL SELECT product_id, 'flow_rate', CAST(regexp_extract(a_capacity, '\\d+') AS DOUBLE), NULL, 'L' FROM raw WHERE a_capacity IS NOT NULL
  UNION ALL SELECT product_id, 'noise_level', CAST(regexp_extract(a_noise, '\\d+') AS DOUBLE), NULL, 'dB' FROM raw WHERE a_noise IS NOT NULL),
merged AS (
  SELECT product_id, field, num, str, unit, 'input' AS origin, 1.0::DOUBLE AS confidence FROM attributes
  UNION ALL SELECT product_id, field, num, str, unit, 'extracted', confidence FROM best ANTI JOIN attributes USING (product_id, field)),
marks AS (SELECT product_id, {_MARK.format("name")} AS nm, {_MARK.format("description")} AS dm FROM raw),
leaf(code, name) AS ({_values((x["code"], x["path"][-1]) for x in TAXONOMY)}),
wanted(code, field, needed) AS ({_values((x["code"], f, str(f in x["required"]).lower()) for x in TAXONOMY for f in dict.fromkeys(x["expected"] + x["required"]))}),
points AS (
  SELECT product_id, code, CASE WHEN contains(nm, term) THEN in_name WHEN contains(dm, term) THEN in_description ELSE 0 END AS p
  FROM marks CROSS JOIN ({_values(_TERMS)}) t(code, term, in_name, in_description)
  UNION ALL SELECT m.product_id, x.code, CAST({WEIGHTS["spec"]} AS DOUBLE) FROM merged m JOIN ({_values((x["code"], f) for x in TAXONOMY for f in dict.fromkeys(x["expected"]))}) x(code, field) USING (field)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, code) AS place, max(score) OVER (PARTITION BY product_id) AS top FROM (
    SELECT product_id, code, sum(p) AS score FROM points GROUP BY ALL HAVING sum(p) > 0)),
confident AS (
  SELECT r.product_id, r.code, r.score, r.place, round(CASE WHEN r.place = 1 THEN least(0.99::DOUBLE, least(r.top / greatest(r.top, 1.0), 1.0) * 0.55::DOUBLE + (r.top - coalesce(s.score, 0)) / r.top * 0.45::DOUBLE)
    ELSE least(0.85::DOUBLE, r.score / greatest(r.top, 1.0) * 0.6::DOUBLE) END, 4) AS confidence
  FROM ranked r LEFT JOIN ranked s ON s.product_id = r.product_id AND s.place = 2),
category AS (
  SELECT raw.product_id, coalesce(g.code, c.code, {q(FALLBACK[0])}) AS code, CASE WHEN g.code IS NOT NULL THEN 'input' WHEN c.code IS NOT NULL THEN 'taxonomy' ELSE 'default' END AS origin,
    CASE WHEN g.code IS NOT NULL THEN 1.0::DOUBLE WHEN c.code IS NOT NULL THEN least(c.confidence, {TRUST["taxonomy"]}::DOUBLE) ELSE 0.2::DOUBLE END AS confidence
  FROM raw LEFT JOIN leaf g ON lower(trim(raw.category)) IN (lower(g.name), lower(g.code)) LEFT JOIN confident c ON c.product_id = raw.product_id AND c.place = 1),
wide AS (
  SELECT product_id, {", ".join(f"max(num) FILTER (field = {q(f)}) AS {c}" for c, f in (("p", "power"), ("v", "voltage"), ("i", "current"), ("f", "frequency"), ("n", "rotational_speed"), ("t", "torque")))},
    CASE WHEN coalesce(max(str) FILTER (field = 'phase'), '') LIKE '3%' THEN {_ROOT3}::DOUBLE ELSE 1.0::DOUBLE END AS phases FROM merged GROUP BY product_id),
facts AS (
  SELECT * FROM merged
  UNION ALL SELECT product_id, 'current', round(p / (v * phases * 0.85::DOUBLE * 0.9::DOUBLE), 2), NULL, 'A', 'derived', 0.7::DOUBLE FROM wide WHERE i IS NULL AND v > 0 AND p IS NOT NULL
  UNION ALL SELECT product_id, 'torque', round(p / (n * {_TURN}::DOUBLE / 60), 2), NULL, 'Nm', 'derived', 0.72::DOUBLE FROM wide WHERE t IS NULL AND n > 0 AND p IS NOT NULL
  UNION ALL SELECT product_id, 'frequency', CASE WHEN {_near(SYNCHRONOUS_50)} THEN 50.0 ELSE 60.0 END, NULL, 'Hz', 'derived', 0.6::DOUBLE FROM wide WHERE f IS NULL AND ({_near(SYNCHRONOUS_50)} OR {_near(SYNCHRONOUS_60)})),
spans AS (
  SELECT f.product_id, f.field, f.num, coalesce(o.lo, a.lo) AS lo, coalesce(o.hi, a.hi) AS hi, o.lo IS NOT NULL AS own FROM facts f JOIN category c USING (product_id)
  LEFT JOIN ({_values((c, f, lo, hi) for c, fs in CATEGORY_RANGES.items() for f, (lo, hi) in fs.items())}) o(code, field, lo, hi) ON o.code = c.code AND o.field = f.field
  LEFT JOIN ({_values((f, lo, hi) for f, (lo, hi) in GLOBAL_RANGES.items())}) a(field, lo, hi) ON a.field = f.field WHERE f.num IS NOT NULL),
final AS (
  SELECT product_id, {", ".join(f"max(num) FILTER (field = {q(f)}) AS {c}" for c, f in (("p", "power"), ("v", "voltage"), ("i", "current"), ("f", "frequency"), ("n", "rotational_speed"), ("t", "torque"), ("w", "width"), ("d", "diameter"), ("l", "length"), ("h", "height"), ("kg", "weight")))},
    CASE WHEN coalesce(max(str) FILTER (field = 'phase'), '') LIKE '3%' THEN {_ROOT3}::DOUBLE ELSE 1.0::DOUBLE END AS phases FROM facts GROUP BY product_id),
coherent AS (
  SELECT *, CASE WHEN v > 0 AND i > 0 THEN p / (v * i * phases) END AS factor, CASE WHEN n > 0 AND t > 0 THEN p / (t * (n * {_TURN}::DOUBLE / 60)) END AS ratio, CASE WHEN l * w * h > 0 THEN kg * 1e6 / (l * w * h) END AS density,
    list_sort(list_transform({_numbers(SYNCHRONOUS_SPEEDS)}, lambda s, k: {{'apart': abs(s - n), 'rank': k, 'speed': s}}))[1].speed AS nearest FROM final),
findings AS (
  SELECT product_id, 'VAL.ID.NAME_MISSING' AS rule, 'critical' AS severity, 'name' AS field FROM raw WHERE trim(name) = ''
  UNION ALL SELECT product_id, 'VAL.ID.NAME_SHORT', 'major', 'name' FROM raw WHERE length(trim(name)) BETWEEN 1 AND 2
  UNION ALL SELECT product_id, 'VAL.ID.WEAK_CATEGORY', 'minor', 'category' FROM category WHERE confidence < 0.35
  UNION ALL SELECT c.product_id, 'VAL.REQ.' || upper(x.field), 'major', x.field FROM category c JOIN wanted x ON x.code = c.code AND x.needed = 'true' ANTI JOIN facts f ON f.product_id = c.product_id AND f.field = x.field
  UNION ALL SELECT DISTINCT c.product_id, 'VAL.REQ.EXPECTED_GAPS', 'minor', 'specifications' FROM category c JOIN wanted x ON x.code = c.code AND x.needed = 'false' ANTI JOIN facts f ON f.product_id = c.product_id AND f.field = x.field
  UNION ALL SELECT product_id, 'VAL.RANGE.NEGATIVE.' || upper(field), 'critical', field FROM spans WHERE num < 0 AND field <> 'max_temperature'
  UNION ALL SELECT product_id, 'VAL.RANGE.' || upper(field), CASE WHEN own THEN 'major' ELSE 'minor' END, field FROM spans WHERE (num < lo OR num > hi) AND NOT (num < 0 AND field <> 'max_temperature')
  UNION ALL SELECT product_id, 'VAL.RANGE.NONSTANDARD_VOLTAGE', 'minor', 'voltage' FROM final WHERE v > 60 AND len(list_filter({_numbers(STANDARD_VOLTAGES)}, lambda s: abs(v - s) / s <= 0.12::DOUBLE)) = 0
  UNION ALL SELECT product_id, 'VAL.COH.POWER_TOO_HIGH', 'major', 'power' FROM coherent WHERE factor > 1.05
  UNION ALL SELECT product_id, 'VAL.COH.POWER_TOO_LOW', 'minor', 'current' FROM coherent WHERE factor < 0.35
  UNION ALL SELECT product_id, 'VAL.COH.SPEED_VS_FREQ', 'minor', 'rotational_speed' FROM coherent WHERE f IN (50, 60) AND n > 0 AND NOT (n >= nearest * 0.9::DOUBLE AND n <= nearest * 1.02::DOUBLE)
  UNION ALL SELECT product_id, 'VAL.COH.POWER_TORQUE_SPEED', 'major', 'torque' FROM coherent WHERE ratio > 1.35 OR ratio < 0.65
  UNION ALL SELECT product_id, 'VAL.COH.ASPECT_RATIO', 'minor', 'width' FROM coherent WHERE w > d * 6
  UNION ALL SELECT product_id, 'VAL.COH.DENSITY', 'minor', 'weight' FROM coherent WHERE density > 25 OR density < 0.02
  UNION ALL SELECT product_id, 'VAL.CONF.LOW', 'minor', 'specifications' FROM facts WHERE confidence < 0.5 GROUP BY product_id),
verdicts AS (
  SELECT r.product_id, count(f.rule) FILTER (f.severity IN ('critical', 'major')) = 0 AS is_valid,
    round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - coalesce(sum(CASE f.severity {" ".join(f"WHEN {q(k)} THEN {v}::DOUBLE" for k, v in PENALTY.items())} END), 0))), 4) AS score, count(f.rule) AS n_findings,
    round(greatest(0.0::DOUBLE, 1.0::DOUBLE - coalesce(sum(CASE f.severity {" ".join(f"WHEN {q(k)} THEN {v}::DOUBLE" for k, v in PENALTY.items())} END) FILTER (f.rule LIKE 'VAL.COH.%'), 0)), 4) AS consistency,
    count(f.rule) FILTER (f.severity = 'critical') AS critical, count(f.rule) FILTER (f.severity = 'major') AS major, count(f.rule) FILTER (f.severity = 'minor') AS minor
  FROM raw r LEFT JOIN findings f USING (product_id) GROUP BY r.product_id),
tokens AS (SELECT product_id, unnest(regexp_extract_all(lower(text), {q("(" + KEYWORD + ")")}, 1)) AS token FROM txt),
words AS (
  SELECT product_id, token, n FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, token) AS place FROM (
    SELECT product_id, token, count(*) AS n FROM tokens WHERE token NOT IN ({", ".join(map(q, STOPWORDS))}) GROUP BY ALL)) WHERE place <= 12),
measures AS (
  SELECT r.product_id, round((2 + (len(coalesce(w.words, [])) > 0)::INT + 1 + coalesce(f.n, 0)) / (4 + coalesce(f.n, 0))::DOUBLE, 4) AS completeness,
    ((2 * (coalesce(f.confidences, 0) + CAST(round(c.confidence * 10000) AS BIGINT)) + coalesce(f.n, 0) + 1) // (2 * (coalesce(f.n, 0) + 1))) / 10000.0::DOUBLE AS mean_confidence, coalesce(f.n, 0) AS specs,
    {", ".join(f"coalesce(f.{o}, 0) AS {o}" for o in ("input", "extracted", "derived"))}, array_to_string(w.words, ',') AS keywords
  FROM raw r JOIN category c USING (product_id) LEFT JOIN (
    SELECT product_id, count(*) AS n, CAST(sum(CAST(round(confidence * 10000) AS BIGINT)) AS BIGINT) AS confidences, {", ".join(f"count(*) FILTER (origin = '{o}') AS {o}" for o in ("input", "extracted", "derived"))} FROM facts GROUP BY ALL) f USING (product_id)
  LEFT JOIN (SELECT product_id, list(token ORDER BY n DESC, token) AS words FROM words GROUP BY ALL) w USING (product_id)),
bits AS (
  SELECT product_id, list(bit ORDER BY place) AS b FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY pick) AS place FROM (
    SELECT product_id, d.pick, CASE WHEN num IS NOT NULL AND unit IS NOT NULL THEN d.label || ' of ' || format('{{:g}}', num) || ' ' || unit ELSE d.label || ' ' || coalesce(str, CAST(num AS VARCHAR)) END AS bit
    FROM facts JOIN ({_values((i, f, f.replace("_", " ")) for i, f in enumerate(DESCRIBED))}) d(pick, field, label) USING (field))) WHERE place <= 4 GROUP BY ALL),
described AS (
  SELECT r.product_id, name || ' is a ' || lower(l.name_of) || CASE coalesce(len(b), 0) WHEN 0 THEN '' WHEN 1 THEN ' rated at  ' || b[1] ELSE ' rated at ' || array_to_string(b[1:-2], ', ') || ' and ' || b[-1] END
    || '. ' || rtrim(description, '.') || '.' AS enriched_description
  FROM raw r JOIN category c USING (product_id) JOIN (SELECT code, name AS name_of FROM leaf UNION ALL SELECT {q(FALLBACK[0])}, {q(FALLBACK[1][-1])}) l USING (code) LEFT JOIN bits USING (product_id))
"""
_TRIGRAMS = "CASE WHEN length(j) >= 3 THEN list_transform(range(1, length(j) - 1), lambda i: substr(j, i, 3)) WHEN j <> '' THEN [j] ELSE [''] END"
_SHOWN = "coalesce(replace(str, ',', ', '), CASE WHEN num = floor(num) THEN CAST(CAST(num AS BIGINT) AS VARCHAR) ELSE format('{:g}', num) END || coalesce(' ' || unit, ''))"
_ORDER = f"CASE WHEN EXISTS (SELECT 1 FROM best WHERE best.product_id = f.product_id AND best.field = f.field) THEN list_position({list(FIELDS)}, field) WHEN origin = 'input' THEN 1000 + list_position(['brand', 'power', 'flow_rate', 'weight', 'noise_level'], field) ELSE 2000 + list_position({list(FIELDS)}, field) END"
_SIMILAR = f""", told AS (SELECT product_id, string_agg(field || ' ' || shown, ' ' ORDER BY place) AS specs FROM (SELECT product_id, field, {_SHOWN} AS shown, {_ORDER} AS place FROM facts f) GROUP BY ALL),
content AS (SELECT product_id, concat_ws(' ', nullif(name, ''), nullif(enriched_description, ''), specs) AS text FROM raw JOIN described USING (product_id) LEFT JOIN told USING (product_id)),
grams AS (SELECT product_id, sha1(unnest({_TRIGRAMS})) AS g FROM (SELECT product_id, array_to_string(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), ' ') AS j FROM content)),
weights AS (SELECT product_id, CAST('0x' || substr(g, 1, 8) AS BIGINT) % 256 AS bucket, sum(CASE WHEN CAST('0x' || substr(g, 10, 1) AS INT) % 2 = 1 THEN 1 ELSE -1 END) AS w FROM grams GROUP BY ALL),
vectors AS (SELECT product_id, list(coalesce(w, 0)::DOUBLE ORDER BY bucket) AS v, sqrt(sum(coalesce(w, 0)::DOUBLE * coalesce(w, 0))) AS norm FROM (SELECT product_id, b.range AS bucket FROM raw CROSS JOIN range(256) b) LEFT JOIN weights USING (product_id, bucket) GROUP BY ALL),
class AS (SELECT product_id, min(product_id) OVER (PARTITION BY text, coalesce(numbers, '')) AS class_id FROM content LEFT JOIN (SELECT product_id, string_agg(field || num || coalesce(unit, '-'), '/' ORDER BY field) AS numbers FROM facts WHERE num IS NOT NULL GROUP BY ALL) USING (product_id))"""
_CONFLICT = """(SELECT min(x.field) FROM facts x JOIN facts y ON x.product_id = p.query AND y.product_id = p.id AND x.field = y.field AND x.num IS NOT NULL AND y.num IS NOT NULL
  WHERE NOT CASE WHEN x.unit IS NULL AND y.unit IS NULL THEN abs(x.num - y.num) <= 1e-9 WHEN x.unit = y.unit THEN abs(x.num - y.num) <= 0.02 * greatest(abs(x.num), abs(y.num)) ELSE false END)"""
_COSINE = "round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 12)"
_ALIKE = f""", pairs AS (SELECT * FROM (SELECT a.product_id AS query, b.product_id AS id, {_COSINE} AS score FROM vectors a JOIN vectors b ON a.product_id < b.product_id
  WHERE a.product_id IN (SELECT class_id FROM class) AND b.product_id IN (SELECT class_id FROM class)) WHERE score >= 0.8)"""
_BLANK = "\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')"


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&"))
_LETTERS = "length(regexp_replace(line, '[^\\p{{{}}}]', '', 'g'))"


def _unescaped(x: str) -> str:
    for entity, plain in _ENTITIES:
        x = f"replace({x}, '{entity}', '{plain}')"
    return x


_PAGES = f"""WITH h AS (SELECT page_id, trim(regexp_replace({_unescaped("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")}, '[{_BLANK}]+', ' ', 'g')) AS h1 FROM pages)
SELECT page_id, nullif(trim(regexp_replace(trim(regexp_replace(h1, {q(HTML_SITE[0].replace("u2013", "x{2013}").replace("u2014", "x{2014}"))}, '')), {q(HTML_SITE[1])}, '')), '') AS name, CAST(0 AS INT) AS attributes FROM h"""
_HEADED = f"""WITH d AS (SELECT doc_id, list_transform(string_split_regex({_strip("coalesce(text, '')")}, '\\r\\n|\\n|\\r'), lambda x: {_strip("x")}) AS lines FROM documents WHERE {_strip("coalesce(text, '')")} <> ''),
l AS (SELECT doc_id, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS spot FROM d),
heads AS (SELECT doc_id, line, spot FROM l WHERE length(line) BETWEEN 4 AND 90 AND NOT regexp_matches(line, '[.,;:]$') AND (regexp_matches(line, {q(NUMBERED)}) OR {_LETTERS.format("L")} > 0 AND {_LETTERS.format("Lu")} > {_LETTERS.format("L")} * 0.75))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS INT) AS block, line AS name FROM heads
UNION ALL SELECT doc_id, 1, lines[1][1:120] FROM d WHERE doc_id NOT IN (SELECT doc_id FROM heads)"""
_OUTLYING = """, moments AS (SELECT code, field, count(*) AS n, avg(num) AS mean, stddev_pop(num) AS deviation FROM facts JOIN category USING (product_id) WHERE num IS NOT NULL GROUP BY ALL HAVING count(*) >= 4 AND stddev_pop(num) > 0),
outlying AS (SELECT product_id, code, field, num, mean, abs((num - mean) / deviation) AS z FROM facts JOIN category USING (product_id) JOIN moments USING (code, field) WHERE abs((num - mean) / deviation) > 3.0)"""
_CONFLICTS = "(SELECT field FROM facts WHERE unit IS NOT NULL GROUP BY field HAVING count(DISTINCT unit) > 1)"
_SQUASHED = r"regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]', '', 'g')"
_ESCAPED = "replace(replace(replace({}, chr(9), '\\t'), chr(10), '\\n'), chr(160), '\\u00a0')"
_PRINT = f"substr(sha256({_SQUASHED.format('name')} || '|' || {_SQUASHED.format('category')}), 1, 16)"

_LABELS = {"input": "From source", "extracted": "Extracted", "derived": "Computed", "taxonomy": "Classified", "llm": "Model-inferred", "default": "Fallback"}
_PATHS = " UNION ALL ".join(f"SELECT {q(c)} AS code, [{', '.join(map(q, p))}] AS path" for c, p in [(x["code"], x["path"]) for x in TAXONOMY] + [FALLBACK])
_NAMES = f"SELECT code, name AS name_of FROM leaf UNION ALL SELECT {q(FALLBACK[0])}, {q(FALLBACK[1][-1])}"
_FACTORS = {"power": "CASE WHEN x LIKE '%kW' THEN 1000 ELSE 745.699872 END", "voltage": "1", "rotational_speed": "1"}
_JUDGED = CATALOG + f""", told AS ({catalog_sql("part", False, truth_columns())}),
asked AS ({" UNION ALL ".join(f"SELECT product_id AS case_id, {q(f)} AS field, x_{f} AS x FROM told WHERE x_{f} IS NOT NULL" for f in TRUTH)}),
judged AS (SELECT case_id, a.field, CASE WHEN f.field IS NULL THEN 'fn' WHEN a.field IN ('ip_rating', 'nominal_bore') THEN CASE WHEN lower(f.str) = lower(x) THEN 'tp' ELSE 'mismatch' END
  WHEN abs(num - y) <= 0.05 * greatest(abs(num), abs(y)) THEN 'tp' ELSE 'mismatch' END AS outcome
  FROM (SELECT *, CAST(regexp_extract(x, '[0-9.]+') AS DOUBLE) * CASE field {" ".join(f"WHEN {q(k)} THEN {v}" for k, v in _FACTORS.items())} END::DOUBLE AS y FROM asked) a LEFT JOIN facts f ON f.product_id = case_id AND f.field = a.field),
scored AS (SELECT t.product_id AS case_id, e.name_of AS expected_category, p.name_of AS predicted, e.name_of = p.name_of AS correct, c.confidence,
  e.name_of = p.name_of OR (c.origin <> 'input' AND EXISTS (SELECT 1 FROM confident a WHERE a.product_id = t.product_id AND a.place IN (2, 3) AND a.code = t.leaf)) AS in_top3,
  (SELECT count(*) FROM judged j WHERE j.case_id = t.product_id AND outcome = 'tp') AS tp, (SELECT count(*) FROM judged j WHERE j.case_id = t.product_id AND outcome <> 'tp') AS fn,
  CAST(greatest(1, (t.a_brand IS NOT NULL)::INT + (t.a_power IS NOT NULL)::INT + (t.a_weight IS NOT NULL)::INT + (t.a_capacity IS NOT NULL)::INT + (t.a_noise IS NOT NULL)::INT + 1 + (t.category IS NOT NULL)::INT) AS BIGINT) AS n_in, CAST(m.specs AS BIGINT) AS n_out, v.score
  FROM told t JOIN category c USING (product_id) JOIN ({_NAMES}) e ON e.code = t.leaf JOIN ({_NAMES}) p ON p.code = c.code JOIN measures m USING (product_id) JOIN verdicts v USING (product_id))
"""

SQL = {
    "raw_catalog": CATALOG + "SELECT product_id, brand, name, description, category, a_brand, a_power, a_weight, a_capacity, a_noise FROM raw",
    "fingerprints": CATALOG + f"SELECT product_id, {_PRINT} AS fingerprint FROM raw",
    "duplicate_members": CATALOG + f"SELECT fingerprint, n, CAST(row_number() OVER (PARTITION BY fingerprint ORDER BY product_id) AS INT) AS place, product_id FROM (SELECT {_PRINT} AS fingerprint, product_id, count(*) OVER (PARTITION BY {_PRINT}) AS n FROM raw) WHERE n > 1",
    "catalog_profile": CATALOG + "SELECT code, field, unit, facts.origin, count(*) AS n, count(num) AS numbers, round(avg(num), 4) AS mean FROM facts JOIN category USING (product_id) GROUP BY ALL",
    "duplicate_groups": CATALOG + f"SELECT {_PRINT} AS fingerprint, count(*) AS n, string_agg(name, '|' ORDER BY product_id) AS names FROM raw GROUP BY 1 HAVING count(*) > 1",
    "extract_best": CATALOG + "SELECT product_id, field, rule, round(num, 6) AS num, str, unit, confidence FROM best",
    "spec_facts": CATALOG + "SELECT product_id, code, field, round(num, 6) AS num, str, unit, facts.origin, facts.confidence FROM facts JOIN category USING (product_id)",
    "classify_best": CATALOG + "SELECT product_id, code, origin, confidence FROM category",
    "classify_ranked": CATALOG + "SELECT product_id, CAST(place AS INT) AS place, code, score, confidence FROM confident WHERE place <= 5",
    "validation_findings": CATALOG + "SELECT * FROM findings",
    "validation_scores": CATALOG + "SELECT product_id, is_valid, score, consistency, CAST(n_findings AS INT) AS n_findings, CAST(critical AS INT) AS critical, CAST(major AS INT) AS major, CAST(minor AS INT) AS minor FROM verdicts",
    "enrich_summary": CATALOG + "SELECT count(*) AS total, count(*) FILTER (is_valid) AS valid, count(*) FILTER (NOT is_valid) AS invalid, round(avg(score), 4) AS mean_score, round(avg(completeness), 4) AS mean_completeness FROM verdicts JOIN measures USING (product_id)",
    "zscore_outliers": CATALOG + _OUTLYING + "SELECT product_id, code, field, round(num, 6) AS num, round(z, 2) AS z, round(mean, 4) AS mean FROM outlying",
    "unit_conflicts": CATALOG + f"SELECT field, unit, count(*) AS n, array_to_string(list(name ORDER BY product_id)[1:3], '|') AS examples FROM facts JOIN raw USING (product_id) WHERE unit IS NOT NULL AND field IN {_CONFLICTS} GROUP BY ALL",
    "content_hash": CATALOG + "SELECT product_id, sha256('{\"attributes\":{' || concat_ws(',', " + ", ".join(f"'\"{k}\":\"' || {_ESCAPED.format(c)} || '\"'" for k, c in ATTRIBUTES.items()) + ") || '},\"description\":\"' || replace(trim(description), '°', chr(92) || 'u00b0') || '\",\"name\":\"' || trim(name) || '\"}') AS content_hash FROM raw",
    "catalog_score": CATALOG + _OUTLYING + f"SELECT records, duplicates, outliers, conflicts, round(greatest(0.0::DOUBLE, 1 - (duplicates + outliers + conflicts) / records::DOUBLE), 4) AS score FROM (SELECT (SELECT count(*) FROM raw) AS records, (SELECT count(*) FROM (SELECT {_PRINT} FROM raw GROUP BY 1 HAVING count(*) > 1)) AS duplicates, (SELECT count(*) FROM outlying) AS outliers, (SELECT count(*) FROM {_CONFLICTS}) AS conflicts)",
    "traceability": CATALOG + "SELECT product_id, CAST(specs AS INT) AS specs, round(coalesce((input + extracted + derived) / nullif(specs, 0)::DOUBLE, 0), 4) AS traceable FROM measures",
    "trust_breakdown": CATALOG + "SELECT product_id, CAST(specs AS INT) AS total_fields, round((input + extracted) / greatest(specs, 1)::DOUBLE, 4) AS verifiable_ratio, round(derived / greatest(specs, 1)::DOUBLE, 4) AS computed_ratio, 0.0::DOUBLE AS model_inferred_ratio, mean_confidence, completeness FROM measures",
    "keywords_top12": CATALOG + "SELECT product_id, coalesce(keywords, '') AS keywords FROM measures",
    "describe_template": CATALOG + "SELECT product_id, enriched_description FROM described",
    "classify_alternatives": CATALOG + "SELECT product_id, CAST(place - 1 AS INT) AS place, confident.code, confident.score, confident.confidence FROM confident JOIN category USING (product_id) WHERE place BETWEEN 2 AND 4 AND category.origin <> 'input'",
    "provenance": CATALOG + "SELECT product_id, origin, count(*) AS n FROM facts GROUP BY ALL",
    "flat_export": CATALOG + "SELECT r.product_id, r.name, c.code, " + ", ".join(f"round(max(num) FILTER (field = '{f}'), 6) AS {f}" for f in ("power", "voltage", "current", "rotational_speed", "torque", "pressure", "flow_rate", "weight")) + " FROM raw r JOIN category c USING (product_id) LEFT JOIN facts f USING (product_id) GROUP BY ALL",
    "attribute_lines": CATALOG + ", lines AS (SELECT product_id, unnest(string_split(text, chr(10))) AS line FROM txt) SELECT product_id, trim(regexp_extract(line, p, 1)) AS key, trim(regexp_extract(line, p, 2)) AS value FROM lines, (SELECT '^\\s*([A-Za-z][A-Za-z0-9 /_().-]{2,40})\\s*[:\\t]\\s*(.+?)\\s*$' AS p) WHERE regexp_extract(line, p, 1) <> '' AND length(regexp_extract(line, p, 2)) < 120",
    "never_ordered": "SELECT p_partkey AS product_id FROM part ANTI JOIN lineitem ON l_partkey = p_partkey",
    "latest_event": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "event_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "job_progress": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY event_type",
    "customer_outliers": "SELECT c_custkey FROM customer JOIN (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS d FROM customer GROUP BY 1) USING (c_nationkey) WHERE n >= 4 AND d > 0 AND abs((c_acctbal - m) / d) > 1.5",
    "quality_agreement": "SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM (SELECT (p AND quality = 1)::INT AS tp, (p AND quality = 0)::INT AS fp, (NOT p AND quality = 1)::INT AS fn, (NOT p AND quality = 0)::INT AS tn FROM (SELECT quality, coalesce(length(text), 0) >= 200 AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL))",
    "lexical_embedding": "SELECT p_partkey AS product_id, CAST(CAST('0x' || substr(sha1(g), 1, 8) AS BIGINT) % 256 AS INT) AS bucket, CAST(sum(CASE WHEN CAST('0x' || substr(sha1(g), 10, 1) AS INT) % 2 = 1 THEN 1 ELSE -1 END) AS BIGINT) AS weight FROM (SELECT p_partkey, unnest(CASE WHEN length(j) >= 3 THEN list_transform(range(1, length(j) - 1), lambda i: substr(j, i, 3)) WHEN j <> '' THEN [j] ELSE [''] END) AS g FROM (SELECT p_partkey, array_to_string(regexp_extract_all(lower(coalesce(p_name, '')), '([a-z0-9]+)', 1), ' ') AS j FROM part)) GROUP BY ALL",
} | {
    "unit_canonical": CATALOG + "SELECT product_id, key, num, unit FROM (SELECT product_id, 'Rated Power' AS key, num, unit FROM attributes WHERE field = 'power' UNION ALL SELECT product_id, 'net weight', num, unit FROM attributes WHERE field = 'weight' AND unit IS NOT NULL UNION ALL SELECT product_id, 'capacity', num, unit FROM attributes WHERE field = 'flow_rate' UNION ALL SELECT product_id, 'noise', num, unit FROM attributes WHERE field = 'noise_level')",
    "unit_agreement": CATALOG + "SELECT product_id, abs(b.num - a.num) <= 0.02 * greatest(abs(a.num), abs(b.num)) AS agrees, true AS same_dimension FROM best b JOIN attributes a USING (product_id, field) WHERE field = 'power'",
    "field_provenance": CATALOG + f"SELECT product_id, field, coalesce(str, CASE WHEN num = floor(num) THEN CAST(CAST(num AS BIGINT) AS VARCHAR) ELSE format('{{:g}}', num) END || coalesce(' ' || unit, '')) AS display, origin, CASE origin {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in _LABELS.items())} END AS origin_label, CASE origin {' '.join(f'WHEN {q(k)} THEN {v}::DOUBLE' for k, v in TRUST.items())} END AS trust, origin IN ('input', 'extracted') AS verifiable, origin = 'input' AND EXISTS (SELECT 1 FROM best WHERE best.product_id = f.product_id AND best.field = f.field) AS overrode FROM (SELECT * REPLACE (replace(str, ',', ', ') AS str) FROM facts) f",
    "spec_rows": CATALOG + "SELECT product_id, CAST(row_number() OVER (PARTITION BY product_id ORDER BY CASE origin WHEN 'input' THEN 0 WHEN 'extracted' THEN 1 ELSE 2 END, field) AS INT) AS place, field, origin FROM facts",
    "category_reasoning": CATALOG + f"SELECT c.product_id, c.code, c.origin, CASE WHEN c.origin = 'taxonomy' THEN round(a.score - coalesce(b.score, 0), 4) END AS margin, coalesce(s.fields, '') AS supporting, c.confidence < 0.45 AS doubtful, CASE WHEN c.origin = 'taxonomy' THEN coalesce(p.terms, '') END AS penalised FROM category c LEFT JOIN confident a ON a.product_id = c.product_id AND a.place = 1 LEFT JOIN confident b ON b.product_id = c.product_id AND b.place = 2 LEFT JOIN (SELECT c.product_id, string_agg(w.field, ',' ORDER BY w.field) AS fields FROM category c JOIN wanted w USING (code) JOIN facts f ON f.product_id = c.product_id AND f.field = w.field GROUP BY ALL) s ON s.product_id = c.product_id LEFT JOIN (SELECT c.product_id, string_agg(n.plain, ',' ORDER BY n.plain) AS terms FROM category c JOIN marks m USING (product_id) JOIN ({_values((x['code'], marked(t), t) for x in TAXONOMY for t in x['negative'])}) n(code, term, plain) ON n.code = c.code AND (contains(m.nm, n.term) OR contains(m.dm, n.term)) GROUP BY ALL) p ON p.product_id = c.product_id",
    "reasoning_chain": CATALOG + f"""SELECT r.product_id, s.place, s.stage, CASE s.place WHEN 1 THEN (coalesce(m.input, 0) + coalesce(m.extracted, 0)) || ' values, ' || CASE WHEN coalesce(m.keywords, '') = '' THEN 0 ELSE len(string_split(m.keywords, ',')) END || ' keywords'
      WHEN 2 THEN c.code || ' (' || c.origin || ')' WHEN 3 THEN coalesce(d.fields, '') WHEN 4 THEN length(t.enriched_description) || ' characters' ELSE CASE WHEN v.is_valid THEN 'valid' ELSE 'invalid' END || ', ' || v.n_findings || ' findings' END AS result
      FROM raw r JOIN category c USING (product_id) JOIN measures m USING (product_id) JOIN described t USING (product_id) JOIN verdicts v USING (product_id)
      LEFT JOIN (SELECT product_id, string_agg(field, ', ' ORDER BY list_position({list(FIELDS)}, field)) AS fields FROM facts WHERE origin = 'derived' GROUP BY ALL) d USING (product_id)
      CROSS JOIN (VALUES (1, 'extract'), (2, 'classify'), (3, 'derive'), (4, 'describe'), (5, 'validate')) s(place, stage)""",
    "validation_reasoning": CATALOG + f"SELECT v.product_id, CASE WHEN is_valid THEN 'valid' ELSE 'invalid' END AS status, score, CAST(14 + coalesce(w.n, 0) + coalesce(r.n, 0) AS INT) AS checked_rules, v.consistency, coalesce(n.blocking, '') AS blocking, coalesce(n.advisory, '') AS advisory FROM verdicts v LEFT JOIN (SELECT product_id, string_agg(concat_ws(':', rule, field), '|' ORDER BY concat_ws(':', rule, field)) FILTER (severity IN ('critical', 'major')) AS blocking, string_agg(concat_ws(':', rule, field), '|' ORDER BY concat_ws(':', rule, field)) FILTER (severity = 'minor') AS advisory FROM findings GROUP BY ALL) n USING (product_id) JOIN category c USING (product_id) LEFT JOIN (SELECT code, count(*) AS n FROM wanted WHERE needed = 'true' GROUP BY code) w USING (code) LEFT JOIN ({_values((c, len(r)) for c, r in CATEGORY_RANGES.items())}) r(code, n) USING (code)",
    "review_queue": CATALOG + f"""SELECT product_id, CAST(row_number() OVER (PARTITION BY product_id ORDER BY priority, field, reason) AS INT) AS place, priority, field, reason, choice FROM (
      SELECT product_id, 1 AS priority, field, rule AS reason, CAST(NULL AS VARCHAR) AS choice FROM findings WHERE severity IN ('critical', 'major')
      UNION ALL SELECT c.product_id, 1, 'category', 'no clear winner', 'choose among: ' || coalesce(a.names, 'none') FROM category c
      LEFT JOIN (SELECT k.product_id, string_agg(l.name, ', ' ORDER BY k.place) AS names FROM confident k JOIN leaf l USING (code) WHERE k.place IN (2, 3) GROUP BY ALL) a ON a.product_id = c.product_id AND c.origin <> 'input' WHERE c.confidence < 0.45)""",
    "explain_summary": CATALOG + f"SELECT product_id, name || ': ' || l.name_of || ', ' || CASE WHEN specs = 0 THEN 'no values found' ELSE CAST(specs AS VARCHAR) || ' values (' || concat_ws(', ', CASE WHEN input > 0 THEN CAST(input AS VARCHAR) || ' from source' END, CASE WHEN extracted > 0 THEN CAST(extracted AS VARCHAR) || ' extracted' END, CASE WHEN derived > 0 THEN CAST(derived AS VARCHAR) || ' computed' END) || '), ' || CAST(CAST(round_even(100 * (input + extracted) / specs::DOUBLE, 0) AS INT) AS VARCHAR) || ' percent stated by the source' END AS summary FROM raw r JOIN category c USING (product_id) JOIN measures USING (product_id) JOIN (SELECT code, name AS name_of FROM leaf UNION ALL SELECT {q(FALLBACK[0])}, {q(FALLBACK[1][-1])}) l USING (code)",
    "flat_rows": CATALOG + f"""SELECT r.product_id, r.name, l.path[-1] AS category, array_to_string(l.path, ' > ') AS category_path, t.enriched_description AS description, coalesce(replace(m.keywords, ',', ', '), '') AS keywords, CASE WHEN v.is_valid THEN 'valid' ELSE 'invalid' END AS validation_status,
      v.score AS validation_score, m.completeness, {", ".join(f"coalesce(max(f.shown) FILTER (f.field = '{x}'), '') AS spec_{x}" for x in [*FIELDS, "brand"])}
      FROM raw r JOIN category c USING (product_id) JOIN measures m USING (product_id) JOIN verdicts v USING (product_id) JOIN described t USING (product_id) JOIN ({_PATHS}) l USING (code) LEFT JOIN (SELECT product_id, field, {_SHOWN} AS shown FROM facts) f USING (product_id) GROUP BY ALL""",
    "result_documents": CATALOG + f"SELECT r.product_id, {_PRINT.replace('category', 'r.category')} AS fingerprint, c.code, CAST(m.specs AS INT) AS spec_count, v.score, f.str AS ip_rating FROM raw r JOIN category c USING (product_id) JOIN measures m USING (product_id) JOIN verdicts v USING (product_id) LEFT JOIN facts f ON f.product_id = r.product_id AND f.field = 'ip_rating'",
    "stored_rows": CATALOG + f"SELECT r.product_id, {_PRINT.replace('category', 'r.category')} AS content_hash, l.path[-1] AS category, CAST(m.specs AS INT) AS spec_count, v.score AS validation_score, m.completeness, false AS llm_used, 'job-1' AS job_id, c.code, r.name, v.score, t.enriched_description AS told FROM raw r JOIN described t USING (product_id) JOIN category c USING (product_id) JOIN measures m USING (product_id) JOIN verdicts v USING (product_id) JOIN ({_PATHS}) l USING (code)",
    "second_run": CATALOG + "SELECT r.product_id, 'hit' AS cache, false AS persisted, c.code, v.score, m.completeness FROM raw r JOIN category c USING (product_id) JOIN measures m USING (product_id) JOIN verdicts v USING (product_id) WHERE trim(r.name) <> ''",
    "missing_from_store": CATALOG + f"SELECT product_id FROM (SELECT product_id, {_PRINT} AS h FROM raw) WHERE h NOT IN (SELECT {_PRINT} FROM raw WHERE product_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49))",
    "cached_or_computed": CATALOG + "SELECT product_id, CASE WHEN EXISTS (SELECT 1 FROM raw o WHERE o.product_id % 2 = 0 AND o.product_id % 3 <> 0 AND trim(o.name) = trim(r.name) AND o.description = r.description AND o.a_brand IS NOT DISTINCT FROM r.a_brand AND o.a_power IS NOT DISTINCT FROM r.a_power AND o.a_weight IS NOT DISTINCT FROM r.a_weight AND o.a_capacity IS NOT DISTINCT FROM r.a_capacity AND o.a_noise IS NOT DISTINCT FROM r.a_noise) THEN 'hit' ELSE 'miss' END AS cache FROM raw r WHERE trim(name) <> ''",
    "recent_topn": "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
    "products_of_jobs": "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 3)",
    "upsert_index": "SELECT key, event_id FROM (SELECT concat_ws('/', user_id, event_type) AS key, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "chunk_offsets": "SELECT product_id, CAST(r // 500 AS BIGINT) AS chunk, CAST(r // 500 * 500 AS BIGINT) AS offset, CAST(least(500, n - r // 500 * 500) AS BIGINT) AS count FROM (SELECT p_partkey AS product_id, row_number() OVER (ORDER BY p_partkey) - 1 AS r, count(*) OVER () AS n FROM part)",
    "value_percentiles": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, " + ", ".join(f"list_sort(list(value))[CAST(least(floor(count(*) * {p}), count(*) - 1) AS INT) + 1] AS p{n}" for p, n in ((0.5, 50), (0.95, 95), (0.99, 99))) + " FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "eval_per_field": _JUDGED + "SELECT case_id, field, outcome FROM judged",
    "eval_per_case": _JUDGED + "SELECT case_id, predicted, correct, in_top3, tp, fn, n_in, n_out, score FROM scored",
    "eval_metrics": _JUDGED + "SELECT count(*) AS cases, round(avg(correct::INT), 4) AS category_accuracy, round(avg(in_top3::INT), 4) AS top3_accuracy, round(avg(confidence), 4) AS mean_confidence, 1.0::DOUBLE AS precision, round(sum(tp) / sum(tp + fn)::DOUBLE, 4) AS recall, round(2 * (sum(tp) / sum(tp + fn)::DOUBLE) / (1 + sum(tp) / sum(tp + fn)::DOUBLE), 4) AS f1, CAST(sum(tp) AS BIGINT) AS tp, 0::BIGINT AS fp, CAST(sum(fn) AS BIGINT) AS fn, 0.0::DOUBLE AS hallucination_rate, round(sum(n_out) / sum(n_in)::DOUBLE, 2) AS lift, round(avg(score), 4) AS mean_score FROM scored",
    "eval_confusion": _JUDGED + "SELECT expected_category, predicted, count(*) AS n FROM scored WHERE NOT correct GROUP BY ALL",
    "confirmed_duplicates": CATALOG + _SIMILAR + f"SELECT query, id, round(score, 4) AS score, {_CONFLICT} AS conflict FROM (SELECT a.product_id AS query, b.product_id AS id, {_COSINE} AS score FROM vectors a JOIN vectors b ON a.product_id % 20 = 0 AND a.product_id <> b.product_id) p WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10",
    "similar_pairs": CATALOG + _SIMILAR + _ALIKE + f"SELECT query, id, round(score, 4) AS score, {_CONFLICT} AS conflict FROM pairs p",
    "similar_records": CATALOG + _SIMILAR + _ALIKE + f", judged AS (SELECT query, id, {_CONFLICT} AS conflict FROM pairs p), ends AS (SELECT unnest([query, id]) AS class_id, conflict FROM judged) SELECT c.product_id, c.class_id, count(e.class_id) AS similar, count(e.class_id) FILTER (e.conflict IS NULL) AS duplicates FROM class c LEFT JOIN ends e USING (class_id) GROUP BY ALL",
    "embedding_topk": "SELECT query, id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rn FROM (SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE rn <= 5",
    "llm_gap_fill": CATALOG + "SELECT r.product_id, CASE WHEN p.field IS NULL THEN 'power' ELSE '' END AS accepted, CASE WHEN p.field IS NULL THEN '' ELSE 'rated power: known from the source|' END || 'colour: not in the schema|weight: ' || CASE WHEN w.field IS NULL THEN 'unknown unit' ELSE 'known from the source' END AS rejected, round(coalesce(p.num, (r.product_id % 50 + 1) * 1000.0::DOUBLE), 6) AS power, coalesce(p.origin, 'llm') AS origin FROM raw r LEFT JOIN facts p ON p.product_id = r.product_id AND p.field = 'power' LEFT JOIN facts w ON w.product_id = r.product_id AND w.field = 'weight'",
    "llm_findings": CATALOG + "SELECT product_id, 'VAL.CONF.LLM_INFERRED' AS rule, 'info' AS severity FROM raw ANTI JOIN (SELECT product_id FROM facts WHERE field = 'power') p USING (product_id)",
    "llm_prompts": CATALOG + f"""SELECT r.product_id, 'Product: ' || coalesce(r.name, '') || chr(10) || 'Text: ' || coalesce(r.description, '') || chr(10) || 'Category: ' || l.path[-1] || chr(10) || 'Known, not to be changed: {{' || coalesce(k.known, '') || '}}' || chr(10)
      || 'Fill only, if the text states or implies it: ' || replace(w.wanted, ',', ', ') || chr(10) || 'Answer with one JSON object: specifications (field to value, unit, basis), attributes, description, category_suggestion.' AS prompt
      FROM raw r JOIN category c USING (product_id) JOIN ({_PATHS}) l USING (code) JOIN (SELECT c.product_id, coalesce(string_agg(w.field, ',' ORDER BY w.i) FILTER (f.field IS NULL AND w.field IS NOT NULL), '') AS wanted FROM category c LEFT JOIN ({_values((x['code'], f, i) for x in TAXONOMY for i, f in enumerate(x['expected']))}) w(code, field, i) USING (code) LEFT JOIN facts f ON f.product_id = c.product_id AND f.field = w.field GROUP BY c.product_id) w ON w.product_id = r.product_id
      LEFT JOIN (SELECT product_id, string_agg('"' || field || '":"' || shown || '"', ',' ORDER BY place) AS known FROM (SELECT product_id, field, {_SHOWN} AS shown, {_ORDER} AS place FROM facts f) GROUP BY ALL) k ON k.product_id = r.product_id""",
    "csv_round_trip": CATALOG + "SELECT product_id, name, description, trim(coalesce(category, '')) AS category, brand AS maker FROM raw WHERE trim(name) <> ''",
    "folder_records": CATALOG + "SELECT product_id, name, description, trim(coalesce(category, '')) AS category, brand AS maker FROM raw WHERE trim(name) <> ''",
    "html_titles": _PAGES,
    "heading_blocks": _HEADED,
    "json_records": "SELECT conv_id, turn, role AS name, CAST(length(trim(regexp_replace(coalesce(text, ''), '[\\s\\x{00a0}]+', ' ', 'g'))) AS INT) AS size FROM conversations WHERE trim(role) <> ''",
    "fetch": CATALOG + f"SELECT {_PRINT} AS content_hash, max(product_id) AS product_id FROM raw GROUP BY 1",
}
