"""Layered rules about fields, and statistics that propose new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.functions import scripts

# Thresholds of proposals.
MIN_UNITS = 4
MIN_SHARE = 0.75


def matches_field(pattern: Column, field: Column) -> Column:
    """Exact, or a suffix after a star; a star alone matches nothing."""
    suffix = F.substring(pattern, F.lit(2), F.char_length(pattern))
    return F.when(pattern.startswith("*"), (suffix != "") & F.endswith(field, suffix)).otherwise(pattern == field)


def apply_rules(units: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds the verdict that holds for each (field, domain): later layers, exact patterns, skips and later positions win.

    Rules meet the distinct (field, domain) pairs, not the units, by equality: a pair offers its field and each of its suffixes after a star.
    """
    kinds = units.select("field", "domain").distinct()
    places = F.when(F.col("field") != "", F.sequence(F.lit(1), F.char_length("field"))).otherwise(F.array().cast("array<int>"))
    suffixes = F.transform(places, lambda i: F.concat(F.lit("*"), F.substring("field", i, F.char_length("field"))))
    offered = kinds.select("field", "domain", F.explode(F.concat(F.array("field"), suffixes)).alias("pattern"))
    test = matches_field(F.col("pattern"), F.col("field")) & (F.col("rule_domain").isNull() | (F.col("rule_domain") == F.col("domain")))
    hits = offered.join(rules, "pattern").where(test)
    best = F.max_by("verdict", F.struct("layer", (~F.col("pattern").startswith("*")).alias("exact"), (F.col("verdict") == "skip").alias("skip"), "position"))
    verdicts = hits.groupBy("field", "domain").agg(best.alias("verdict"))
    return units.join(verdicts, ["field", "domain"], "left")


def field_stats(df: DataFrame) -> DataFrame:
    """total, machine, identical and passthrough units of each field, and its domains. df: field, domain, source_text, target_text, passthrough."""
    same = scripts.trim(F.col("source_text")) == scripts.trim(F.col("target_text"))
    return df.groupBy("field").agg(
        F.count("*").alias("total"),
        F.count_if(scripts.machine_literal(F.col("source_text"))).alias("machine"),
        F.count_if(~F.col("passthrough") & same).alias("identical"),
        F.count_if(F.col("passthrough")).alias("passthrough"),
        F.array_join(F.sort_array(F.collect_set("domain")), ",").alias("domains"),
    )


def propose_skips(stats: DataFrame) -> DataFrame:
    """Fields with enough units of which most need no translation, with the reason that weighs most."""
    most = F.greatest("machine", "passthrough", "identical")
    reason = F.when(F.col("machine") == most, "machine").when(F.col("passthrough") == most, "passthrough").otherwise("identical")
    domain = F.when(~F.contains("domains", F.lit(",")), F.col("domains"))
    return stats.where((F.col("total") >= MIN_UNITS) & (most / F.col("total") >= MIN_SHARE)).select("field", "total", reason.alias("reason"), (most / F.col("total")).alias("share"), domain.alias("domain"))
