"""Quality rules whose limits follow the data: quantile sketches per language and source, then one joined filter.

The sketch counts values in logarithmic buckets, so a quantile is within one bucket (two per cent) of the exact one.
Sketches of parts merge by adding counts, in any order, and give the same limits on every run. Each quantile of a
language is a mean of its own, with the weight of its documents, and that of all documents, with the weight PRIOR; that
of a language and source is drawn to its language's likewise. So a group with few documents follows its language, one
with many itself, and no number of documents is a switch. Only documents that pass the base rules are sketched.

Where the quartiles of a statistic differ and the lower one is not zero, its limits are the outer fences, three
interquartile ranges off. Elsewhere (most documents have none of it, or all the same) they are outer quantiles of the
core, the documents inside the inner fences of the other statistics. If non-zero values begin above that quantile, the
limit lies halfway to where they begin: few documents have any of it, and a trace is no reason to drop one.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import look_up, staged
from .docstats import rule_stats

GAMMA = 1.02
SMALLEST = 1e-3
MIN_WORDS, MOST_REPEATED = 20, 30
#: statistic -> whether it has a lower limit as well
RULES = {"symbols_per_word": False, "dup_line_ratio": False, "repeat_ratio": False, "upper_ratio": False, "word_length": True}
INNER, FENCE = 1.5, 3.0
OUTER = 0.98
BEGIN = 0.05
#: How many documents the quantiles one level up count as; how many non-zero values where those begin counts as.
PRIOR, PRIOR_NONZERO = 50.0, 5.0
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


def _stats():
    names = [x.split()[0] for x in STATS.split(", ")]

    @F.pandas_udf(STATS)
    def stats(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rule_stats(t) for t in text], columns=names, dtype="int64")

    return stats


def _bucket(value: Column) -> Column:
    return F.when(value < SMALLEST, F.lit(0)).otherwise(F.ceil(F.log(value / SMALLEST) / math.log(GAMMA)).cast("int") + 1)


def _value(bucket: Column) -> Column:
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), bucket - 1.5) * SMALLEST)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts and ratios of each text."""
    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), _stats()(F.col("text").cast("string")).alias("s"))
    s = s.select("doc_id", "lang", "source", "s.*")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return s.withColumns({
        "symbols_per_word": ratio("n_symbols", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "upper_ratio": ratio("n_upper", "word_chars"), "word_length": ratio("word_chars", "n_words"),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
    })


def _edge(bucket: Column) -> Column:
    """The highest value of a bucket."""
    return F.pow(F.lit(GAMMA), F.greatest(bucket - 1, F.lit(0))) * (SMALLEST * (1 + 1e-9))


def sketches(stats: DataFrame) -> DataFrame:
    """lang, source, stat, bucket, n: the mergeable sketch of each group, over documents that pass the base rules."""
    long = stats.filter(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), _bucket(F.col(k)).alias("bucket")) for k in RULES])).alias("x"))
    return long.groupBy("lang", "source", "x.stat", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stat, docs, nonzero, q25, q75, low, high, begin of sketches merged by the keys; begin is of non-zero values."""
    merged = sketch.groupBy(*keys, "stat", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "stat")
    ranked = merged.withColumns({"docs": F.sum("n").over(by), "upto": F.sum("n").over(by.orderBy("bucket")), "zero": F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(F.lit(0))).over(by)})
    q = lambda p: F.min(F.when(F.col("upto") >= F.col("docs") * p, F.col("bucket")))
    begin = F.min(F.when((F.col("bucket") > 0) & (F.col("upto") - F.col("zero") >= (F.col("docs") - F.col("zero")) * BEGIN), F.col("bucket")))
    return ranked.groupBy(*keys, "stat").agg(F.max("docs").alias("docs"), F.max(F.col("docs") - F.col("zero")).alias("nonzero"), _value(q(0.25)).alias("q25"), _value(q(0.75)).alias("q75"), _edge(q(1 - OUTER) - 1).alias("low"), _edge(q(OUTER)).alias("high"), _value(begin).alias("begin"))


def by_group(sketch: DataFrame, groups: DataFrame, prior: float) -> DataFrame:
    """The quantiles for each language and source of groups, drawn to those of the level above; null where no document at all has one."""
    every = groups.select("lang", "source", F.explode(F.array(*map(F.lit, RULES))).alias("stat"))
    levels = [[], ["lang"], ["lang", "source"]]
    for i, keys in enumerate(levels):
        q = quantiles(sketch, keys)
        every = every.join(q.select(*keys, "stat", *[F.col(c).alias(f"{c}{i}") for c in ("docs", "nonzero", "q25", "q75", "low", "high", "begin")]), [*keys, "stat"], "left")

    def drawn(name: str, count: str, weight: float) -> Column:
        value = F.col(f"{name}0")
        for i in range(1, len(levels)):
            own, n = F.col(f"{name}{i}"), F.col(f"{count}{i}").cast("double")
            value = F.coalesce((own * n + value * weight) / (n + weight), own, value)
        return value.alias(name)

    return every.select("lang", "source", "stat", *[drawn(c, "docs", prior) for c in ("q25", "q75", "low", "high")], drawn("begin", "nonzero", prior * PRIOR_NONZERO / PRIOR))


def _wide(use: DataFrame) -> DataFrame:
    pick = lambda k, end: F.max(F.when(F.col("stat") == k, F.col(end))).alias(f"{k}_{end}")
    return use.groupBy("lang", "source").agg(*[pick(k, "highest") for k in RULES], *[pick(k, "lowest") for k, low in RULES.items() if low])


def _breaks(k: str) -> Column:
    """Whether statistic k is outside its limits; null where it has none."""
    over = F.col(k) > F.col(f"{k}_highest")
    return over | (F.col(k) < F.col(f"{k}_lowest")) if RULES[k] else over


def _named(df: DataFrame) -> DataFrame:
    """df with two hashes of language and source, 128 bits in all: a key of fixed width."""
    return df.withColumns({"group": F.xxhash64("lang", "source"), "group2": F.xxhash64(F.lit(1), "lang", "source")})


def with_limits(stats: DataFrame, allowed: DataFrame, groups: DataFrame) -> DataFrame:
    """stats with the limits of each document's language and source. A group that holds many documents is no hot key: see look_up.

    groups has n, the number of documents of each language and source.
    """
    table = _named(allowed.join(groups, ["lang", "source"])).drop("lang", "source")
    return look_up(_named(stats), staged(table, "allowed"), ["group", "group2"]).drop("group", "group2")


def limits(stats: DataFrame, groups: DataFrame, prior: float = PRIOR) -> DataFrame:
    """One row per language and source of groups: the lowest and highest value allowed of each statistic."""
    spread = F.col("q75") - F.col("q25")
    varied = (F.col("q25") > 0) & (spread > 0)
    fences = staged(by_group(staged(sketches(stats), "sketch"), groups, prior), "fences")
    inner = _wide(fences.withColumns({"highest": F.when(varied, F.col("q75") + spread * INNER), "lowest": F.when(varied, F.col("q25") - spread * INNER)}))
    outside = F.lit(False)
    for k in RULES:
        outside = outside | F.coalesce(_breaks(k), F.lit(False))
    core = by_group(staged(sketches(with_limits(stats, inner, groups).filter(~outside)), "core"), groups, prior).select("lang", "source", "stat", F.col("low").alias("core_low"), F.col("high").alias("core_high"))
    halfway = F.greatest(F.col("core_high"), (F.col("core_high") + F.col("begin")) / 2)
    use = fences.join(core, ["lang", "source", "stat"], "left")
    return _wide(use.withColumns({"highest": F.when(varied, F.col("q75") + spread * FENCE).otherwise(halfway), "lowest": F.when(varied, F.col("q25") - spread * FENCE).otherwise(F.col("core_low"))}))


def apply_rules(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """One row per document: counts, base_failed, kept and the names of the rules it broke.

    A null text has no words and fails the base rules. Null languages and sources form a group of their own. Repeated
    rows get equal verdicts. An empty table gives no rows. Other columns are ignored.
    """
    stats = staged(statistics(docs), "stats")
    groups = staged(stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "groups")
    judged = with_limits(stats, limits(stats, groups, prior), groups)
    broken = F.filter(F.array(*[F.when(_breaks(k), F.lit(k)) for k in RULES]), lambda x: x.isNotNull())
    judged = judged.withColumn("broken", broken)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken")
