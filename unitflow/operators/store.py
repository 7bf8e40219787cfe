"""Operators on the unit table and its cache of translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["unit_id", "source_hash"]


def pending(units: DataFrame, translations: DataFrame) -> DataFrame:
    """Units without a translation of their present source. units: id and source_hash; translations: unit_id and source_hash."""
    return units.withColumnRenamed("id", "unit_id").join(translations, KEYS, "left_anti").withColumnRenamed("unit_id", "id")


def purge(translations: DataFrame, units: DataFrame) -> DataFrame:
    """Translations whose unit still exists with the same source."""
    return translations.join(units.select(F.col("id").alias("unit_id"), "source_hash"), KEYS, "left_semi")


def matched(units: DataFrame, translations: DataFrame) -> DataFrame:
    """Every unit with its translation, or nulls."""
    return units.withColumnRenamed("id", "unit_id").join(translations, KEYS, "left").withColumnRenamed("unit_id", "id")


def counts(units: DataFrame, translations: DataFrame, *by: str) -> DataFrame:
    """total, translated, passthrough and pending units, of all or by group; one pass over one join."""
    df = matched(units, translations.withColumn("found", F.lit(True)))
    total, done = F.count("*"), F.count_if(F.col("found") & ~F.col("passthrough"))
    passed = F.count_if(F.col("found") & F.col("passthrough"))
    return df.groupBy(*by).agg(total.alias("total"), done.alias("translated"), passed.alias("passthrough"), F.greatest(total - done - passed, F.lit(0)).alias("pending"))


def export(units: DataFrame, translations: DataFrame, which: str) -> DataFrame:
    """Units to export: pending, translated (passed through ones included), passthrough or all."""
    df = matched(units, translations.withColumn("found", F.lit(True)))
    found, passed = F.coalesce("found", F.lit(False)), F.coalesce("passthrough", F.lit(False))
    tests: dict[str, Column] = {"pending": ~found, "translated": found, "passthrough": found & passed, "all": F.lit(True)}
    if which not in tests:
        raise ValueError(f"unknown filter {which!r}; one of {', '.join(tests)}")
    return df.where(tests[which])


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new in place of those of equal keys."""
    return old.join(new, list(keys), "left_anti").unionByName(new)
