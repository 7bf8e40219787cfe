"""Scripts of subtitles and games, and JSON lists: units by windows within a file, and by native JSON parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitflow.functions import ids, scripts
from unitflow.sources.lines import lines
from unitflow.sources.tables import exploded, json_keys

# First words of lines that hold a quoted string but no dialogue.
NO_DIALOGUE = ("voice", "play", "queue", "show", "scene", "image", "jump", "call", "pause", "stop", "window", "hide", "with")
QUOTED = r'"((?:[^"\\]++|\\.)*+)"'


def ass_units(df: DataFrame, source: Column, text_col: str = "text", *keep: str) -> DataFrame:
    """Dialogue rows of the events section. The last format row before a row names its fields; text is the last field, commas
    included, and role the name. Rows of override tags alone have no text."""
    files = Window.partitionBy(*keep).orderBy("pos")
    own = lines(df, text_col, *keep).withColumn("line", scripts.trim(F.col("line")))
    section = F.last(F.when(F.col("line").rlike(r"^\["), F.lower("line")), ignorenulls=True).over(files)
    layout = F.last(F.when(F.col("line").startswith("Format:"), F.substring(F.col("line"), F.lit(8), F.char_length("line"))), ignorenulls=True).over(files)
    own = own.select("*", section.alias("section"), layout.alias("layout")).where((F.col("section") == "[events]") & F.col("line").startswith("Dialogue:"))
    names = F.transform(F.split(F.coalesce("layout", F.lit("layer,start,end,style,name,marginl,marginr,marginv,effect,text")), ","), lambda n: F.lower(F.trim(n)))
    own = own.select("*", names.alias("names")).select("*", F.call_function("split", F.substring(F.col("line"), F.lit(10), F.char_length("line")), F.lit(","), F.size("names")).alias("fields"))
    own = own.where(F.size("fields") == F.size("names"))
    at = F.array_position("names", "name").cast("int")
    own = own.select("*", F.element_at("fields", -1).alias("body"), F.when(at > 0, F.trim(F.get("fields", at - 1))).otherwise("").alias("role"))
    own = own.where(scripts.needs_translation(F.regexp_replace("body", r"\{[^}]*\}", ""), source))
    own = own.withColumn("location", F.format_string("L%06d", "pos")).withColumn("context", F.format_string("s%04d", F.floor((F.col("pos") - 1) / 40))).withColumn("original_lines", F.array("body"))
    return own.select(*keep, "pos", ids.unit_id(F.lit("ass"), F.col("location"), F.col("original_lines")).alias("id"), "location", "context", "role", "original_lines")


def renpy_units(df: DataFrame, source: Column, text_col: str = "text", *keep: str) -> DataFrame:
    """Strings inside translate blocks: dialogue lines, and the old string of each pair at the line of its new one. A block begins at an unindented
    line and ends at the next."""
    files = Window.partitionBy(*keep).orderBy("pos")
    own = lines(df, text_col, *keep)
    outer = F.col("line").rlike(r"^\S") & ~F.col("line").startswith("#")
    inside = F.last(F.when(outer, F.col("line").startswith("translate ")), ignorenulls=True).over(files)
    found = F.regexp_extract_all("line", F.lit(QUOTED), F.lit(1))
    own = own.select("*", inside.alias("inside"), scripts.trim(F.col("line")).alias("bare"), F.try_element_at(found, F.lit(-1)).alias("quoted"))
    own = own.select("*", F.regexp_extract("bare", r"^[^\s\"]*", 0).alias("word")).where("inside and bare not like '#%' and quoted is not null and bare not like 'translate %'")
    own = own.select("*", F.last(F.when(F.col("word") == "old", F.col("quoted")), ignorenulls=True).over(files).alias("old"))
    spoken = ~F.col("word").isin("old", "new", *NO_DIALOGUE)
    text = F.when(F.col("word") == "new", F.col("old")).when(spoken, F.col("quoted"))
    plain = F.replace(F.replace(F.replace(text, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
    own = own.select("*", plain.alias("plain"), F.when(F.col("word") == "new", "strings").otherwise("dialogue").alias("domain")).where(scripts.needs_translation(F.col("plain"), source))
    own = own.withColumn("location", F.format_string("n%06d", "pos")).withColumn("context", F.format_string("s%04d", F.floor((F.col("pos") - 1) / 60))).withColumn("original_lines", F.split("plain", "\n"))
    return own.select(*keep, "pos", ids.unit_id(F.lit("renpy"), F.col("location"), F.col("original_lines")).alias("id"), "domain", "location", "context", "original_lines")


def json_list_units(df: DataFrame, source: Column, kind: str, text_col: str = "text", *keep: str) -> DataFrame:
    """Units of three JSON shapes: mtool ({text: anything}), paratranz ([{key, original, translation}], open records only) and vnt ([{name, message}], the
    name as role). Values are parsed by Spark, keys in Arrow batches: Spark's parser refuses a key of more than 50,000 characters."""
    if kind == "mtool":
        own = exploded(df, text_col, keep, "pos long, value string", json_keys).select(*keep, "pos", "value", F.lit("").alias("role"), F.lit("").alias("done"))
        letter, width = "k", 50
    elif kind == "paratranz":
        parsed = F.from_json(text_col, "array<struct<key:string,original:string,translation:string>>")
        rows = F.posexplode(F.transform(parsed, lambda r: F.struct(r["original"].alias("value"), F.lit("").alias("role"), F.coalesce(r["translation"], F.lit("")).alias("done"))))
        letter, width = "p", 50
    elif kind == "vnt":
        parsed = F.from_json(text_col, "array<struct<name:string,message:string>>")
        rows = F.posexplode(F.transform(parsed, lambda r: F.struct(r["message"].alias("value"), F.coalesce(r["name"], F.lit("")).alias("role"), F.lit("").alias("done"))))
        letter, width = "m", 40
    else:
        raise ValueError(f"unknown shape {kind!r}")
    if kind != "mtool":
        own = df.select(*keep, rows.alias("pos", "r")).select(*keep, F.col("pos").cast("long").alias("pos"), "r.*")
    own = own.where((scripts.trim(F.col("done")) == "") & scripts.needs_translation(F.col("value"), source))
    own = own.withColumn("location", F.format_string(f"{letter}%06d", "pos")).withColumn("context", F.format_string("s%04d", F.floor(F.col("pos") / width))).withColumn("original_lines", F.split("value", "\n"))
    return own.select(*keep, "pos", ids.unit_id(F.lit(kind), F.col("location"), F.col("original_lines")).alias("id"), "location", "context", "role", "original_lines")


def profile_units(df: DataFrame, source: Column, rules: list[tuple[str, int, int]], skip: list[str], name: str = "custom", text_col: str = "text", *keep: str) -> DataFrame:
    """Lines by a user's rules: the first (pattern, group of text, group of role or 0) that matches a line gives its unit; lines that match a skip
    pattern give none. Patterns are Java's, without look-around or back-references, so that each line costs linear time."""
    for pattern in [*skip, *(p for p, _, _ in rules)]:
        if any(x in pattern for x in ("(?=", "(?!", "(?<=", "(?<!")) or any(f"\\{d}" in pattern for d in range(1, 10)):
            raise ValueError(f"look-around and back-references are not allowed: {pattern}")
    own = lines(df, text_col, *keep)
    for pattern in skip:
        own = own.where(~F.col("line").rlike(pattern))
    pick = F.coalesce(*(F.when(F.col("line").rlike(p), F.struct(F.regexp_extract("line", p, t).alias("value"), (F.regexp_extract("line", p, r) if r else F.lit("")).alias("role"))) for p, t, r in rules))
    own = own.select(*keep, "pos", pick.alias("r")).select(*keep, "pos", "r.*").where(scripts.needs_translation(F.col("value"), source))
    own = own.withColumn("location", F.format_string("L%06d", "pos")).withColumn("context", F.format_string("s%04d", F.floor((F.col("pos") - 1) / 50))).withColumn("original_lines", F.array("value"))
    return own.select(*keep, "pos", ids.unit_id(F.lit(name), F.col("location"), F.col("original_lines")).alias("id"), "location", "context", "role", "original_lines")
