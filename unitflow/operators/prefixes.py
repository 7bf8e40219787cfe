"""Longest prefixes by equality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_of(units: DataFrame, files: DataFrame, location_col: str = "location", file_col: str = "file", sign: str = "#") -> DataFrame:
    """units with file: the longest of the files' names that its location begins with, a sign following; null if there is none.

    A location offers what stands before each of its signs, so names are met by equality: rows grow with the signs of the distinct locations, and no location
    is compared with each name. Locations, then results, are shuffled; a frequent name is a hot key of a join that Spark can split, no group.
    """
    places = units.select(F.col(location_col).alias("__location")).where(F.col("__location").isNotNull()).distinct()
    parts = F.split("__location", f"\\Q{sign}\\E")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), sign))
    offered = places.where(F.size(parts) > 1).select("__location", F.explode(upto).alias("__file"))
    names = files.select(F.col(file_col).alias("__file")).distinct()
    found = offered.join(names, "__file").groupBy("__location").agg(F.max_by("__file", F.length("__file")).alias("file"))
    return units.join(found, units[location_col] == found["__location"], "left").select(*(units[c] for c in units.columns), found["file"])
