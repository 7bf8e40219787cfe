"""A model's raw answers as rows, and their way into the cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_span(text: Column) -> Column:
    """The widest span between brackets, of the kind that opens first; null if there is none."""
    kind = F.regexp_extract(text, r"[{\[]", 0)
    span = F.when(kind == "{", F.regexp_extract(text, r"(?s)\{.*\}", 0)).when(kind == "[", F.regexp_extract(text, r"(?s)\[.*\]", 0))
    return F.when(span != "", span)


def answer_rows(raw: DataFrame, text_col: str = "raw", *keep: str) -> DataFrame:
    """keep, id and translation_lines of each row of the answers that is sound: its id is a string or a whole number and its lines are strings. Of the
    rows of an id the first counts; an answer that is no array gives none."""
    parsed = F.try_variant_get(F.try_parse_json(json_span(F.col(text_col))), "$", "array<variant>")
    rows = raw.select(*keep, F.posexplode(parsed).alias("__k", "__row"))
    ident = F.coalesce(F.try_variant_get("__row", "$.id", "string"))
    kind, lines = F.schema_of_variant(F.try_variant_get("__row", "$.id", "variant")), F.try_variant_get("__row", "$.translation_lines", "variant")
    good = kind.isin("STRING", "BIGINT") & F.schema_of_variant(lines).isin("ARRAY<STRING>", "ARRAY<VOID>")
    rows = rows.where(good).select(*keep, "__k", ident.alias("id"), F.try_variant_get(lines, "$", "array<string>").alias("translation_lines"))
    return rows.groupBy(*keep, "id").agg(F.min_by("translation_lines", "__k").alias("translation_lines"))


def without_passthrough(translations: DataFrame) -> DataFrame:
    """The cache without units that were passed through."""
    return translations.where(~F.coalesce("passthrough", F.lit(False)))


def published(old: DataFrame, new: DataFrame, key: str = "unit_id") -> DataFrame:
    """The cache after a reading of published files: translations of units found there are those, the others go."""
    return new.join(old.select(key), key, "left_semi")


def repaired(old: DataFrame, new: DataFrame, key: str = "unit_id") -> DataFrame:
    """The cache after a repair: new translations replace old ones, but what was passed through never replaces a translation."""
    keep = old.select(key).withColumn("__had", F.lit(True))
    better = new.join(keep, key, "left").where(~F.col("passthrough") | F.col("__had").isNull()).drop("__had")
    return old.join(better.select(key), key, "left_anti").unionByName(better)
