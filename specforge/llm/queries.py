"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, hardneg, langid, linededup, lmscore, packing, pieces, quality_model, rules, simhash, tokencount, trainorder, turns
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.deduplicate(docs)


OP2_SQL = f"""
WITH occ AS (
  SELECT doc_id, pos, lines[pos + 1] AS line FROM (
    SELECT doc_id, lines, unnest(range(len(lines))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
d AS (
  SELECT line, min(CAST(doc_id AS HUGEINT) * {linededup.PLACES} + pos) AS place, count(*) AS n, length(line) AS size
  FROM occ WHERE length(line) >= {linededup.LEAST_CHARS} GROUP BY line),
near AS (
  SELECT DISTINCT b.line FROM d a JOIN d b ON a.place < b.place AND b.size BETWEEN a.size - {linededup.TAU} AND a.size + {linededup.TAU}
  WHERE least(a.size, b.size) >= {linededup.NEAR_CHARS} AND levenshtein(a.line, b.line) <= {linededup.TAU}),
marked AS (
  SELECT o.doc_id, o.pos, o.line, n.line IS NOT NULL AS near,
         n.line IS NOT NULL OR coalesce(d.place <> CAST(o.doc_id AS HUGEINT) * {linededup.PLACES} + o.pos, false) AS gone
  FROM occ o LEFT JOIN d USING (line) LEFT JOIN near n ON n.line = o.line)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) AS n_lines,
       count(*) FILTER (gone) AS n_removed, count(*) FILTER (near) AS n_near
FROM marked GROUP BY doc_id
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "similarity")


OP3_SQL = f"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 'i', item_id, list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark),
s AS (
  SELECT kind, id, len(w) AS total, unnest(range(greatest(len(w) - {decontam.SHINGLE - 1}, 1))) AS pos, w FROM w WHERE len(w) > 0),
h AS (SELECT kind, id, total, pos, array_to_string(w[pos + 1 : pos + {decontam.SHINGLE}], ' ') AS h FROM s),
spot AS (
  SELECT DISTINCT d.id AS doc_id, i.id AS item_id, i.total AS isize, least(i.total, d.total) AS size,
         greatest(0, least(d.pos - i.pos, d.total - least(i.total, d.total))) AS start
  FROM h d JOIN h i ON d.h = i.h WHERE d.kind = 'd' AND i.kind = 'i'),
wh AS (
  SELECT p.doc_id, p.item_id, p.start, p.size, d.h, count(*) AS n FROM spot p JOIN h d ON d.kind = 'd' AND d.id = p.doc_id
  AND d.pos BETWEEN p.start AND p.start + greatest(p.size - {decontam.SHINGLE}, 0) GROUP BY ALL),
ih AS (SELECT id AS item_id, h, count(*) AS n FROM h WHERE kind = 'i' GROUP BY ALL),
num AS (SELECT wh.doc_id, wh.item_id, wh.start, wh.size, sum(least(wh.n, coalesce(ih.n, 0))) AS both_n, sum(wh.n) AS own FROM wh LEFT JOIN ih USING (item_id, h) GROUP BY ALL),
sim AS (SELECT num.*, CAST(both_n AS DOUBLE) / CAST(own + t.n - both_n AS DOUBLE) AS similarity FROM num JOIN (SELECT item_id, sum(n) AS n FROM ih GROUP BY ALL) t USING (item_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS rn FROM sim WHERE similarity >= {decontam.SIMILARITY})
SELECT doc_id, item_id, CAST(start AS INT) AS start, CAST(size AS INT) AS n_words, similarity FROM best WHERE rn = 1
"""


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.predictions(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokencount.count_edited(docs, tokencount.sample_edits(docs["text"]))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_train_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trainorder.sharded(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encode_and_decode(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(own.select("vec_id", label.alias("label"), hardneg.whole_parts(F.col("embedding")).alias("parts")))


OP12_SQL = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS vec_id, b.label AS label, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {hardneg.POSITIVES})
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own
WHERE {hardneg.LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {hardneg.HIGH} * p.positive_score
QUALIFY rank <= {hardneg.NEGATIVES}
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damaged(table(spark, sf_dir, "conversations")))


def _after(state: str, cost: str, letter: str, line: str | None = None) -> str:
    text = f"{state}.r || chr(10) || {line}" if line else f"{state}.r"
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', r := {text})"


def _least(*states: str) -> str:
    return f"list_sort([{', '.join(states)}])[1]"


def _when(test: str, value: str) -> str:
    return f"CASE WHEN {test} THEN {value} ELSE struct_pack(c := {turns.FAR}, a := '', r := '') END"


def _stepped() -> str:
    """The states after one row, before rows are put in behind it."""
    fee = f"{turns.UNFINISHED} * CAST(m.open_end AS INT)"
    keep = lambda state, initial: _when(f"m.initial = '{initial}' AND NOT m.must_go", _after(state, fee, "K", "m.role || ':' || m.text"))
    rename = lambda state, role: _when("NOT m.must_go", _after(state, f"{turns.RENAME} + {fee}", "R", f"'{role}:' || m.text"))
    drop = [_after(f"w.s{i}", str(turns.DELETE), "D") for i in range(4)]
    to_user = [f(f"w.s{i}", x) for i in (0, 1, 3) for f, x in ((keep, "u"), (rename, "user"))]
    return f"{drop[0]} AS t0, {_least(drop[1], keep('w.s0', 's'))} AS t1, {_least(drop[2], *to_user)} AS t2, {_least(drop[3], keep('w.s2', 'a'), rename('w.s2', 'assistant'))} AS t3"


_PUT = [f"{_least('t2', *[_after(f't{i}', str(turns.INSERT), 'I', repr('user:')) for i in (0, 1, 3)])} AS p2", _after("p2", str(turns.INSERT), "I", "'assistant:'")]
_WHITE = "\\x20\\x09-\\x0D"

OP13_SQL = f"""
WITH RECURSIVE codes AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) AS r(i)),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations),
hashed AS (
  SELECT named.*, xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, codes.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault FROM named, codes),
hurt AS (
  SELECT g, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^{_WHITE}]') AS blank FROM hurt),
m AS (
  SELECT *, twice AND NOT blank AS duplicate, blank OR twice AS must_go, unended AND NOT blank AND NOT twice AS open_end, coalesce(previous || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM (
    SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS twice, regexp_matches(text, '[^.!?{_WHITE}][{_WHITE}]*$') AS unended, lag(initial) OVER (PARTITION BY g ORDER BY i) AS previous FROM placed)),
w AS (
  SELECT g, CAST(0 AS BIGINT) AS i, t0 AS s0, t1 AS s1, p2 AS s2, {_least('t3', _PUT[1])} AS s3 FROM (
    SELECT *, {_PUT[0]} FROM (
      SELECT DISTINCT g, struct_pack(c := 0::BIGINT, a := '', r := '') AS t0, struct_pack(c := {turns.FAR}, a := '', r := '') AS t1, struct_pack(c := {turns.FAR}, a := '', r := '') AS t2, struct_pack(c := {turns.FAR}, a := '', r := '') AS t3 FROM named))
  UNION ALL
  SELECT g, i, t0, t1, p2, {_least('t3', _PUT[1])} FROM (
    SELECT *, {_PUT[0]} FROM (SELECT w.g, m.i, {_stepped()} FROM w JOIN m ON m.g = w.g AND m.i = w.i + 1))),
totals AS (
  SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (open_end) AS truncated, count(*) FILTER (illegal) AS illegal FROM m GROUP BY g),
best AS (SELECT w.g, {_least('s0', 's3')} AS b FROM w LEFT JOIN totals USING (g) WHERE w.i = coalesce(totals.n, 0))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       b.c AS cost, b.a AS audit, sha256(substr(b.r, 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM named) c JOIN best USING (g) LEFT JOIN totals USING (g)
"""


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_decontamination, op4_lm_scoring, op5_token_counts, op6_quality_classifier, op7_train_order, op8_quality_rules, op9_simhash, op10_packing, op11_sentencepiece, op12_hard_negatives, op13_conversation_repair)}
    return found


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op3_decontamination": OP3_SQL, "op12_hard_negatives": OP12_SQL, "op13_conversation_repair": OP13_SQL}
