"""Predictions against labelled cases: per field, per case and in all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import EVALUATION_TOLERANCE, MEASUREMENT
from ..functions.sql import let, raw, strip
from ..functions.units import canonical_sql, resolve_sql
from ..plans.shared import staged

#: Steps of the grid of quantiles that brackets a place.
GRID = 1000
CASE = "name string, description string, input_category string, attributes map<string,string>, expected_category string, expected_specs map<string,string>, notes string"


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id and the columns of CASE from JSON lines; blank lines and `//` comments are skipped, malformed ones are an error.

    Lists among the expected values stay JSON text.
    """
    told = F.when(~F.col("value").rlike(r"^\s*(//.*)?$"), F.col("value"))  # a filter alone could come after the parsing
    lines = spark.read.text(path).select(told.alias("value")).filter("value IS NOT NULL")
    read = lines.select(F.from_json("value", CASE, {"mode": "FAILFAST"}).alias("c"), F.xxhash64("value").alias("case_id")).select("case_id", "c.*")
    return read.withColumn("name", F.when(F.col("name").isNull(), F.raise_error(F.lit("a case has no name"))).otherwise(F.col("name")))


def measurement(text: str) -> str:
    """SQL of number and unit of a text such as `2.2 kW`; null if it is none or the unit is unknown."""
    p = raw("(?U)" + MEASUREMENT)
    parts = f"named_struct('number', try_cast(replace(regexp_extract({text}, {p}, 1), ',', '') as double), 'unit', {strip(f'regexp_extract({text}, {p}, 2)')})"
    return let(parts, "m", f"if(m.number IS NOT NULL AND {resolve_sql('m.unit')} IS NOT NULL, m, null)")


def close(a: str, b: str, tolerance: float) -> str:
    return f"({a} = {b} OR abs({a} - {b}) / greatest(abs({a}), abs({b})) <= {tolerance!r}D)"


def values_match(expected: str, actual: str, tolerance: float = EVALUATION_TOLERANCE) -> str:
    """SQL: does a value (num, str, list) meet what is expected, written as text?

    A measurement is compared in canonical units, a JSON list as a subset, other texts without regard to case; a text
    against a list asks for membership.
    """
    low = lambda x: f"lower({strip(x)})"
    canonical = let(f"{measurement(expected)}", "m", f"if(m IS NULL, null, {let(resolve_sql('m.unit'), 'r', canonical_sql('m.number', 'r'))})")
    number = f"CASE WHEN {actual}.num IS NULL THEN false ELSE {close('c', f'{actual}.num', tolerance)} END"
    own = f"transform(coalesce({actual}.list, array(coalesce({actual}.str, cast({actual}.num as string)))), x -> {low('x')})"
    wanted = f"transform(from_json({expected}, 'array<string>'), x -> {low('x')})"
    plain = f"CASE WHEN {actual}.num IS NOT NULL AND try_cast({expected} as double) IS NOT NULL THEN {close(f'try_cast({expected} as double)', f'{actual}.num', tolerance)} WHEN startswith(ltrim({expected}), '[') THEN size(array_except({wanted}, {own})) = 0 ELSE array_contains({own}, {low(expected)}) END"
    return f"coalesce({let(canonical, 'c', f'if(c IS NOT NULL, {number}, {plain})')}, false)"


def per_field(cases: DataFrame, enriched: DataFrame, tolerance: float = EVALUATION_TOLERANCE) -> DataFrame:
    """case_id, field, outcome: tp, fn, mismatch (a wrong value, which counts as missed) or fp (a model's value nobody asked for).

    cases has case_id, expected_specs; enriched has product_id (the case's id) and specs. A case without a prediction
    misses all its fields.
    """
    want = cases.select("case_id", F.explode("expected_specs").alias("field", "expected"))
    have = enriched.select(F.col("product_id").alias("case_id"), F.explode("specs").alias("v")).select("case_id", F.col("v.field").alias("field"), "v")
    both = want.join(have, ["case_id", "field"], "full_outer")
    outcome = f"CASE WHEN expected IS NULL THEN if(v.origin = 'llm', 'fp', null) WHEN v IS NULL THEN 'fn' WHEN {values_match('expected', 'v', tolerance)} THEN 'tp' ELSE 'mismatch' END"
    return both.selectExpr("case_id", "field", f"{outcome} AS outcome", "expected", "coalesce(v.str, array_join(v.list, ','), cast(v.num as string)) AS got", "v.origin AS origin").filter("outcome IS NOT NULL")


def same_category(a: Column, b: Column) -> Column:
    return F.lower(F.trim(F.coalesce(a, F.lit("")))) == F.lower(F.trim(F.coalesce(b, F.lit(""))))


def fields_in(cases: DataFrame) -> Column:
    """How many fields the source gave: attributes, description and category, one at least."""
    have = lambda c: (F.coalesce(F.col(c), F.lit("")) != "").cast("int") if c in cases.columns else F.lit(0)
    attributes = F.coalesce(F.size("attributes"), F.lit(0)) if "attributes" in cases.columns else F.lit(0)
    return F.greatest(F.lit(1), F.greatest(attributes, F.lit(0)) + have("description") + have("input_category"))


def per_case(cases: DataFrame, enriched: DataFrame, tolerance: float = EVALUATION_TOLERANCE) -> DataFrame:
    """case_id, tp, fp, fn, mismatches, correct, in_top3, predicted, confidence, n_in, n_out, score."""
    fields = per_field(cases, enriched, tolerance).groupBy("case_id").agg(
        F.count_if(F.col("outcome") == "tp").alias("tp"), F.count_if(F.col("outcome") == "fp").alias("fp"), F.count_if(F.col("outcome").isin("fn", "mismatch")).alias("fn"), F.count_if(F.col("outcome") == "mismatch").alias("mismatches")
    )
    found = enriched.select(F.col("product_id").alias("case_id"), F.col("category.name").alias("predicted"), F.col("category.confidence").alias("confidence"), F.transform(F.slice("alternatives", 1, 2), lambda a: a["name"]).alias("near"), F.size("specs").alias("n_out"), F.col("validation.score").alias("score"))
    joined = cases.select("case_id", "expected_category", fields_in(cases).alias("n_in")).join(found, "case_id", "left").join(fields, "case_id", "left")
    correct = same_category(F.col("predicted"), F.col("expected_category"))
    top = correct | F.coalesce(F.exists("near", lambda n: same_category(n, F.col("expected_category"))), F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select("case_id", "expected_category", "predicted", correct.alias("correct"), top.alias("in_top3"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), *map(zero, ("tp", "fp", "fn", "mismatches", "n_in", "n_out")), F.coalesce("score", F.lit(0.0)).alias("score"))


def aggregate(cases: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, hallucination rate and lift over the rows of per_case, in one row."""
    s = cases.agg(F.count(F.lit(1)).alias("cases"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "n_in", "n_out")], *[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(f"mean_{c}") for c in ("correct", "in_top3", "confidence", "score")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    r4 = lambda c: F.round(c, 4)
    return s.select("cases", r4(F.col("mean_correct")).alias("category_accuracy"), r4(F.col("mean_in_top3")).alias("top3_accuracy"), r4(F.col("mean_confidence")).alias("mean_confidence"), r4(p).alias("precision"), r4(r).alias("recall"), r4(ratio(2 * p * r, p + r)).alias("f1"), "tp", "fp", "fn", r4(ratio(F.col("fp"), F.col("n_out"))).alias("hallucination_rate"), F.round(F.try_divide(F.col("n_out"), F.col("n_in")), 2).alias("lift"), r4(F.col("mean_score")).alias("mean_score"))


def confusion(cases: DataFrame) -> DataFrame:
    """expected_category, predicted and n of the misclassified cases."""
    return cases.filter(~F.col("correct")).groupBy("expected_category", "predicted").agg(F.count(F.lit(1)).alias("n"))


def percentiles(df: DataFrame, value: str, by: list[str] | None = None, points: tuple[float, ...] = (0.5, 0.95, 0.99), within: int = 100_000) -> DataFrame:
    """The value at place floor(n * p) of the sorted ones, counted from zero, for each point; n and the mean. Exact.

    A grid of approximate quantiles, merged from all partitions, brackets each place between two values; exact counts
    say what lies below and between them. While more than `within` rows lie between, these alone are bracketed again;
    then they are sorted. So no task sorts a whole group, and a value that most rows share is found by its bracket.
    """
    keys = by or []
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("_at"), F.lit(p).alias("_p")) for i, p in enumerate(points)])).alias("_x")
    kind = rows.schema["_v"].dataType
    every = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_mean")).select("*", places).select("*", "_x.*").drop("_x")
    rank = F.least(F.floor(F.col("_n") * F.col("_p")), F.col("_n") - 1)
    edge = F.lit(None).cast(kind)
    wanted = staged(every.withColumns({"_rank": rank, "_lo": edge, "_hi": edge, "_before": F.lit(0).cast("long"), "_inside": F.col("_n"), "_open": F.col("_n") > within}), "places")

    def between(targets: DataFrame) -> DataFrame:
        """The rows between the edges of each target; targets are as few as groups and points."""
        few = F.broadcast(targets) if targets.count() <= 50_000 else targets
        named = few.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & rows[k].eqNullSafe(F.col(f"_k{i}"))
        inside = (F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))
        return rows.join(named, same & inside)

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        """left with the columns of right for the same group and point."""
        own = [*keys, "_at"]
        other = right.withColumnsRenamed({k: f"_g{i}" for i, k in enumerate(own)})
        same = F.lit(True)
        for i, k in enumerate(own):
            same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
        return left.join(other, same).drop(*[f"_g{i}" for i in range(len(own))])

    for _ in range(12):
        rest = wanted.filter("_open")
        if rest.isEmpty():
            break
        grid = staged(between(rest).groupBy(*keys, "_at").agg(F.percentile_approx("_v", [i / GRID for i in range(GRID + 1)], 10 * GRID).alias("_grid")), "grid")
        share = (F.col("_rank") - F.col("_before")) / F.col("_inside") * GRID
        at = lambda i: F.when((i >= 0) & (i <= GRID), F.get("_grid", i.cast("int")))
        edges = {"_low": F.coalesce(at(F.floor(share) - 1), "_lo"), "_high": F.coalesce(at(F.ceil(share) + 1), "_hi")}
        tried = staged(met(rest, grid).withColumns(edges).drop("_grid"), "brackets")
        below = F.count_if(F.col("_v") < F.col("_low")).alias("_below")
        upto = F.count_if(F.col("_high").isNull() | (F.col("_v") <= F.col("_high"))).alias("_upto")
        counted = staged(between(tried).groupBy(*keys, "_at").agg(below, upto), "brackets")
        fits = (F.col("_before") + F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_upto"))
        better = {"_lo": F.col("_low"), "_hi": F.col("_high"), "_before": F.col("_before") + F.col("_below"), "_inside": F.col("_upto") - F.col("_below")}
        moved = met(tried, counted).select(*[F.when(fits, better[c]).otherwise(F.col(c)).alias(c) if c in better else F.col(c) for c in wanted.columns if c != "_open"])
        still = (F.col("_inside") > within) & ~F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(False))
        wanted = staged(wanted.filter("NOT _open").unionByName(moved.withColumn("_open", still)), "places")
    settled = F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(False))
    few = between(wanted.filter(~settled)).groupBy(*keys, "_at", "_v").agg(F.count(F.lit(1)).alias("_m"), F.first("_rank").alias("_rank"), F.first("_before").alias("_before"))
    upto = F.col("_before") + F.sum("_m").over(Window.partitionBy(*keys, "_at").orderBy("_v"))
    found = few.withColumn("_upto", upto).filter("_upto > _rank").groupBy(*keys, "_at").agg(F.min("_v").alias("_v"))
    found = found.unionByName(wanted.filter(settled).select(*keys, "_at", F.col("_lo").alias("_v")))
    heads = wanted.filter("_at = 0").select(*keys, F.lit(None).cast("int").alias("_at"), edge.alias("_v"), "_n", "_mean")
    at = lambda i, p: F.max(F.when(F.col("_at") == i, F.col("_v"))).alias(f"p{round(p * 100)}")
    both = heads.unionByName(found, allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.max("_n").alias("n"), F.max("_mean").alias("mean"), *[at(i, p) for i, p in enumerate(points)])
