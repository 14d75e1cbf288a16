"""Checks over a whole catalogue: duplicates, outliers, unit conflicts, summaries, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fingerprint
from ..plans.shared import staged

EXAMPLES = 3


def spec_facts(enriched: DataFrame) -> DataFrame:
    """product_id, code, field, num, str, unit, origin, confidence: a row per specification; lists are joined by commas."""
    s = enriched.select("product_id", F.col("category.code").alias("code"), F.explode("specs").alias("s"))
    return s.select("product_id", "code", "s.field", "s.num", F.coalesce("s.str", F.array_join("s.list", ",")).alias("str"), "s.unit", "s.origin", "s.confidence")


def duplicate_members(records: DataFrame) -> DataFrame:
    """fingerprint, n, place, product_id and name of every record whose squashed name and category another has too: a row each.

    Groups are counted first; places are numbered within a group, streaming over its sorted rows.
    """
    keyed = records.select("product_id", "name", fingerprint(F.col("name"), F.col("category")).alias("fingerprint"))
    several = keyed.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(several, "fingerprint").select("fingerprint", "n", F.row_number().over(Window.partitionBy("fingerprint").orderBy("product_id", "name")).alias("place"), "product_id", "name")


def duplicate_groups(records: DataFrame, most: int = 1000) -> DataFrame:
    """fingerprint, n and names of groups of equal records: the first names by product_id, as many as most; n counts all, duplicate_members lists them."""
    named = duplicate_members(records).filter(F.col("place") <= most)
    names = named.groupBy("fingerprint", "n").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("m"))
    return names.select("fingerprint", "n", F.transform("m", lambda x: x["name"]).alias("names"))


def profile(facts: DataFrame) -> DataFrame:
    """code, field, unit, origin, n, numbers, mean and spread (the sum of squared distances from the mean): one pass over the facts.

    Rows of it merge: moments and counts by fewer keys come from it and not from the facts.
    """
    values = F.count("num").alias("numbers"), F.avg("num").alias("mean"), (F.var_pop("num") * F.count("num")).alias("spread")
    return facts.groupBy("code", "field", "unit", "origin").agg(F.count(F.lit(1)).alias("n"), *values)


def moments(profiled: DataFrame) -> DataFrame:
    """code, field, n, mean and deviation (of the population) of the numeric values, merged from a profile."""
    parts = profiled.filter("numbers > 0").groupBy("code", "field").agg(F.sum("numbers").alias("n"), (F.sum(F.col("numbers") * F.col("mean")) / F.sum("numbers")).alias("mean"), F.collect_list(F.struct("numbers", "mean", "spread")).alias("parts"))
    spread = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["spread"] + p["numbers"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return parts.select("code", "field", "n", "mean", F.sqrt(spread / F.col("n")).alias("deviation"))


def few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, to be broadcast if it has few rows: it should be staged. Attributes bring in fields of any name, so their number is counted."""
    return F.broadcast(df) if df.count() <= most else df


def outliers(facts: DataFrame, threshold: float = 3.0, least: int = 4, profiled: DataFrame | None = None) -> DataFrame:
    """Numeric values far from the mean of their category and field, in population standard deviations: z, mean, deviation.

    Moments are merged before they are joined back, so that a category that holds most rows is no single task. facts is
    read twice, once with a profile: stage it where its making is dear.
    """
    numeric = facts.filter("num IS NOT NULL")
    own = moments(profile(facts) if profiled is None else profiled)
    usual = few(staged(own.filter((F.col("n") >= least) & (F.col("deviation") > 0)), "moments"))
    z = F.abs((F.col("num") - F.col("mean")) / F.col("deviation"))
    return numeric.join(usual, ["code", "field"]).withColumn("z", z).filter(F.col("z") > threshold)


def unit_conflicts(facts: DataFrame, names: DataFrame, profiled: DataFrame | None = None) -> DataFrame:
    """field, unit, n, examples (first names by product_id) of fields that are measured in several units."""
    units = (profile(facts) if profiled is None else profiled).filter("unit IS NOT NULL").groupBy("field", "unit").agg(F.sum("n").alias("n"))
    units = staged(units.withColumn("units", F.count(F.lit(1)).over(Window.partitionBy("field"))).filter("units > 1").drop("units"), "units")
    by = Window.partitionBy("field", "unit").orderBy("product_id")
    ranked = facts.filter("unit IS NOT NULL").join(few(units.select("field", "unit")), ["field", "unit"]).select("field", "unit", "product_id", F.row_number().over(by).alias("place")).filter(F.col("place") <= EXAMPLES)
    named = ranked.join(names.select("product_id", "name"), "product_id").groupBy("field", "unit").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("m"))
    return units.join(named, ["field", "unit"]).select("field", "unit", "n", F.transform("m", lambda x: x["name"]).alias("examples"))


def summary(enriched: DataFrame) -> DataFrame:
    """total, valid, invalid, mean_score, mean_completeness, in one row."""
    return enriched.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("validation.is_valid").alias("valid"), F.count_if(~F.col("validation.is_valid")).alias("invalid"),
        F.coalesce(F.round(F.avg("validation.score"), 4), F.lit(0.0)).alias("mean_score"), F.coalesce(F.round(F.avg("completeness"), 4), F.lit(0.0)).alias("mean_completeness"),
    )


def catalogue_score(records: DataFrame, facts: DataFrame, threshold: float = 3.0, profiled: DataFrame | None = None) -> DataFrame:
    """records, duplicates (groups), outliers (values), conflicts (fields) and the score: one less issues per record, not below zero."""
    profiled = staged(profile(facts), "profile") if profiled is None else profiled
    units = profiled.filter("unit IS NOT NULL").groupBy("field").agg(F.count_distinct("unit").alias("units")).filter("units > 1")
    groups = records.groupBy(fingerprint(F.col("name"), F.col("category")).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))
    parts = {"records": records, "duplicates": groups.filter("n > 1"), "outliers": outliers(facts, threshold, profiled=profiled), "conflicts": units}
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    all_ = counted[0].union(counted[1]).union(counted[2]).union(counted[3])
    wide = all_.agg(*[F.max(F.when(F.col("part") == name, F.col("n"))).alias(name) for name in parts])
    issues = F.col("duplicates") + F.col("outliers") + F.col("conflicts")
    return wide.withColumn("score", F.round(F.greatest(F.lit(0.0), F.lit(1.0) - issues / F.greatest("records", F.lit(1))), 4))


def provenance(facts: DataFrame) -> DataFrame:
    """product_id, origin, n: how many values of a record come from where."""
    return facts.groupBy("product_id", "origin").agg(F.count(F.lit(1)).alias("n"))


def traceability(enriched: DataFrame) -> DataFrame:
    """Share of specifications that come from the source, its text or a computation; zero without any."""
    traced = F.size(F.filter("specs", lambda s: s["origin"].isin("input", "extracted", "derived")))
    return enriched.select("product_id", F.size("specs").alias("specs"), F.round(F.coalesce(F.try_divide(traced, F.size("specs")), F.lit(0.0)), 4).alias("traceable"))
