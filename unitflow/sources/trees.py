"""JSON trees by rules of a profile or by what reads like text, and settings files: units by native filters over leaves and lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitflow.functions import ids, prose, scripts
from unitflow.sources.lines import lines
from unitflow.sources.tables import exploded, json_leaves

_LEAF = "leaf long, path string, value string, kind string"
NUMBER = r"^[0-9]+$"


def glob_pattern(glob: str) -> str:
    """A pattern for a path that ends with a slash: * is one part of it, ** any number of parts."""
    parts = {"*": "[^/]+/", "**": "(?:[^/]+/)*"}
    return "^" + "".join(parts.get(g, re.escape(g) + "/") for g in glob.split("/") if g) + "$"


def _strings(df: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    return exploded(df, text_col, keep, _LEAF, json_leaves).where("kind = 'string'")


def _units(own: DataFrame, engine: str, keep: tuple[str, ...], context: Column) -> DataFrame:
    own = own.withColumn("location", F.col("path")).withColumn("context", context).withColumn("original_lines", F.split("value", "\n"))
    return own.select(*keep, ids.unit_id(F.lit(engine), F.col("location"), F.col("original_lines")).alias("id"), "location", "context", "original_lines")


def profile_tree_units(df: DataFrame, source: Column, keys: list[str], globs: list[str], text_col: str = "text", *keep: str) -> DataFrame:
    """String leaves under one of the keys, at any depth (what stands in a list has the list's key), or at a path that a glob matches."""
    own = _strings(df, text_col, keep)
    key = F.try_element_at(F.filter(F.split("path", "/"), lambda p: ~p.rlike(NUMBER)), F.lit(-1))
    by_path = F.concat("path", F.lit("/")).rlike("|".join(map(glob_pattern, globs))) if globs else F.lit(False)
    own = own.where((F.coalesce(key.isin(*keys), F.lit(False)) if keys else F.lit(False)) | by_path).where(scripts.needs_translation(F.col("value"), source))
    return _units(own, "custom", keep, F.format_string("s%04d", F.floor(F.col("leaf") / 50)))


def tree_units(df: DataFrame, source: Column, text_col: str = "text", *keep: str) -> DataFrame:
    """String leaves of any JSON that read like text and stand under no key for programs."""
    own = _strings(df, text_col, keep).where(~F.exists(F.split("path", "/"), prose.machine_key))
    own = own.where(prose.human_text(F.col("value")) & scripts.needs_translation(F.col("value"), source))
    return _units(own, "auto", keep, F.lit("json"))


def path_counts(df: DataFrame, text_col: str = "text", limit: int = 20) -> DataFrame:
    """path, n and strings of the most frequent paths of leaves, places in lists as stars: a report of limit rows."""
    own = exploded(df, text_col, (), _LEAF, json_leaves)
    path = F.regexp_replace("path", r"(?<![^/])[0-9]+(?![^/])", "*")
    return own.groupBy(path.alias("path")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "string").alias("strings")).orderBy(F.desc("n"), "path").limit(limit)


def setting_units(df: DataFrame, source: Column, text_col: str = "text", *keep: str) -> DataFrame:
    """Values of settings (key = value or key: value, below [section] lines) that read like text, where neither the key nor the section is for programs.
    Comments after a value are left out: after = from any # or ;, after : from a # that follows a blank. A value in double quotation marks is a JSON
    string, one in single marks is as it stands, comment signs included; a value that only begins with a mark is none."""
    own = lines(df, text_col, *keep).withColumn("line", scripts.trim(F.col("line")))
    section = F.coalesce(F.last(F.when(F.col("line").rlike(r"^\[[^\]]*\]$"), F.regexp_extract("line", r"^\[([^\]]*)\]$", 1)), ignorenulls=True).over(Window.partitionBy(*keep).orderBy("pos")), F.lit(""))
    pair = r"^([A-Za-z_][\w.-]*)\s*([=:])\s*(.*)$"
    own = own.withColumn("section", section).where(~F.col("line").rlike(r"^[#;\[]") & F.col("line").rlike(pair))
    own = own.withColumn("raw", F.regexp_extract("line", pair, 3))
    after = r"\s*(?:[#;].*)?$"  # a comment, if anything, follows what is quoted
    double, single = rf'^"((?:[^"\\]++|\\.)*+)"{after}', rf"^'([^']*+)'{after}"
    literal = F.get(F.from_json(F.concat(F.lit('["'), F.regexp_extract("raw", double, 1), F.lit('"]')), "array<string>"), F.lit(0))
    bare = F.when(F.regexp_extract("line", pair, 2) == "=", F.regexp_replace("raw", r"\s*[#;].*$", "")).otherwise(F.regexp_replace("raw", r"(?:^|\s+)#.*$", ""))
    value = F.when(F.col("raw").rlike(double), literal).when(F.col("raw").rlike(single), F.regexp_extract("raw", single, 1)).when(~F.col("raw").rlike("^[\"']"), bare)
    own = own.select(*keep, "pos", F.concat_ws("/", F.when(F.col("section") != "", F.col("section")), F.regexp_extract("line", pair, 1)).alias("path"), value.alias("value")).where(value.isNotNull())
    own = own.where(~F.exists(F.split("path", "[/.]"), prose.machine_key) & prose.human_text(F.col("value")) & scripts.needs_translation(F.col("value"), source))
    return _units(own, "auto", keep, F.lit("settings"))
