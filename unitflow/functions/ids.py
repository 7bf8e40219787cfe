"""Stable identity of text units, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _body(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")


def unit_id(engine: Column, location: Column, lines: Column) -> Column:
    """The first 24 hexadecimal digits of a hash over engine, location and lines."""
    return F.substring(F.sha2(F.concat(engine, F.lit("\x00"), location, F.lit("\x00"), _body(lines)), 256), 1, 24)


def source_hash(lines: Column) -> Column:
    return F.sha2(_body(lines), 256)


def dedupe_last(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key: the last by order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
