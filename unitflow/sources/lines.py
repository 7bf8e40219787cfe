"""Line-based sources: plain text, Markdown, subtitles and lyrics, as rows of units.

Input is a table with a file name and its text; all splitting is done by Spark expressions and windows within a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitflow.functions import ids, scripts


def lines(df: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """keep, pos (1-based) and line of each line: split at line feeds, without a last carriage return, without a last empty line."""
    parts = F.split(F.regexp_replace(F.col(text_col), r"\n\z", ""), "\n")
    out = df.where(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(*keep, F.posexplode(parts).alias("i", "line"))
    return out.select(*keep, (F.col("i") + 1).cast("long").alias("pos"), F.regexp_replace("line", r"\r\z", "").alias("line"))


def _unit(df: DataFrame, engine: str, domain: str, location: Column, context: Column, item_type: str, texts: Column, keep: tuple[str, ...]) -> DataFrame:
    df = df.select(*keep, "pos", F.lit(engine).alias("engine"), F.lit(domain).alias("domain"), location.alias("location"), context.alias("context"), F.lit(item_type).alias("item_type"), texts.alias("original_lines"))
    return df.select(*keep, "pos", ids.unit_id(F.col("engine"), F.col("location"), F.col("original_lines")).alias("id"), "engine", "domain", "location", "context", "item_type", "original_lines", ids.source_hash(F.col("original_lines")).alias("source_hash"))


def txt_units(df: DataFrame, source: Column, text_col: str = "text", *keep: str) -> DataFrame:
    """A unit for each line in the source language."""
    own = lines(df, text_col, *keep).where(scripts.needs_translation(F.col("line"), source))
    context = F.format_string("s%06d", F.floor((F.col("pos") - 1) / 50))
    return _unit(own, "txt", "text", F.format_string("L%06d", "pos"), context, "short_text", F.array("line"), keep)


def md_units(df: DataFrame, source: Column, text_col: str = "text", *keep: str) -> DataFrame:
    """Lines outside fenced blocks, without leading heading, quote and list marks; prefix holds the marks' bytes.

    A fence is a line that begins with three backticks or tildes; whether a line lies inside is the parity of the fences before it.
    """
    own = lines(df, text_col, *keep)
    fence = F.col("line").rlike(r"^\s*(?:```|~~~)").cast("int")
    before = F.sum(fence).over(Window.partitionBy(*keep).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    own = own.select("*", fence.alias("fence"), before.alias("fences")).where("fence = 0 and fences % 2 = 0")
    marks = F.regexp_extract("line", r"^(?: {0,3}(?:#{1,6} +|> ?|[-*+] +|[0-9]+[.)] +))*+", 0)
    own = own.withColumn("prefix", F.octet_length(marks).cast("long")).withColumn("line", F.substring(F.col("line"), F.char_length(marks) + 1, F.char_length("line")))
    own = own.where(scripts.needs_translation(F.col("line"), source))
    context = F.format_string("s%06d", F.floor((F.col("pos") - 1) / 50))
    units = _unit(own, "md", "text", F.format_string("L%06d", "pos"), context, "short_text", F.array("line"), (*keep, "prefix"))
    return units


def cue_units(df: DataFrame, source: Column, text_col: str = "text", *keep: str) -> DataFrame:
    """Subtitle cues: blocks between blank lines; the text of a block is what stands after its timing line."""
    own = lines(df, text_col, *keep)
    files = Window.partitionBy(*keep).orderBy("pos")
    blank = scripts.trim(F.col("line")) == ""
    own = own.withColumn("starts", (~blank & F.coalesce(scripts.trim(F.lag("line").over(files)) == "", F.lit(True))).cast("int"))
    own = own.withColumn("block", F.sum("starts").over(files.rowsBetween(Window.unboundedPreceding, 0))).where(~blank)
    blocks = own.groupBy(*keep, "block").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    blocks = blocks.withColumn("texts", F.transform("rows", lambda r: r["line"]))
    timing = F.array_position(F.transform("texts", lambda t: F.contains(t, F.lit("-->"))), True).cast("int")
    blocks = blocks.withColumn("at", timing).where("at > 0 and at < size(texts)")
    blocks = blocks.withColumn("own", F.slice("texts", F.col("at") + 1, F.size("texts") - F.col("at"))).withColumn("pos", (F.col("block") - 1).cast("long"))
    blocks = blocks.where(scripts.needs_translation(F.array_join("own", "\n"), source))
    return _unit(blocks, "srt", "subtitle", F.format_string("c%05d", "pos"), F.format_string("s%04d", F.floor(F.col("pos") / 40)), "long_text", F.col("own"), keep)


def lrc_units(df: DataFrame, source: Column, text_col: str = "text", *keep: str) -> DataFrame:
    """Lyrics: what follows the time tags of a line; lines whose first tag is no time are metadata."""
    own = lines(df, text_col, *keep)
    tags = F.regexp_extract("line", r"^(?:\[[0-9][^\]]*+\])++", 0)
    own = own.withColumn("tags", tags).where("tags <> ''").withColumn("line", F.substring(F.col("line"), F.char_length("tags") + 1, F.char_length("line")))
    own = own.where(scripts.needs_translation(F.col("line"), source))
    return _unit(own, "lrc", "lyrics", F.format_string("L%06d", "pos"), F.lit("lrc"), "short_text", F.array("line"), keep)
