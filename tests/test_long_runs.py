"""Java's regular expressions recurse for each turn of a group; long texts that repeat what a pattern repeats must not end the JVM."""

import pytest
from pyspark.sql import functions as F

from unitflow.functions import kana, masks, prose, quality, scripts
from unitflow.operators import layout, review
from unitflow.sources import lines, trees
from unitflow.sources import scripts as script_files

N = 1 << 16
RUNS = ["> ", ">", "- ", "1. ", "[00:01.00]", "ー", "っすよ", "漢字ー", '"a" ', '\\"', "[CTRL_1]", " [CTRL_12]", "\\C[1]", "\\\\", " \n", "\n", "\r\n", " ", "é", "Ab/", "a.b", "a@b.", "「", "」", "9", "{a}", "%d ", "key = v\n", "<a b=c>", "Dialogue: ,", "-", "0", "A"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, head + run * (N // len(run))) for k, (run, head) in enumerate((r, h) for r in RUNS for h in ("", "漢字"))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


EXPRESSIONS = {
    "needs_translation": lambda t: scripts.needs_translation(t, F.lit("en")),
    "residual_script": lambda t: scripts.residual_script(t, F.lit("ja"), F.lit("zh")),
    "machine_literal": scripts.machine_literal,
    "latin_residue": lambda t: scripts.latin_residue(F.lit("some words"), t),
    "line_shape": scripts.line_shape,
    "display_width": lambda t: scripts.display_width(t, masks.CONTROL),
    "natural_key": scripts.natural_key,
    "field_of": scripts.field_of,
    "kana_kind": lambda t: kana.kana_kind(F.array(t), F.lit("zh")),
    "human_text": prose.human_text,
    "machine_key": prose.machine_key,
    "sanitised": lambda t: quality.sanitised(F.array(t), F.lit("short_text")),
    "restored": lambda t: quality.restored(F.array(F.lit("")), F.array(t), F.array(t)),
    "label_fault": lambda t: review.label_fault(F.array(t, t), F.array(t, t), "[【]([^】]+)[】]", masks.CONTROL),
}


@pytest.mark.parametrize("name", EXPRESSIONS)
def test_expressions(texts, name):
    out = texts.select(F.length(F.to_json(F.struct(EXPRESSIONS[name](F.col("text")).alias("x")))).alias("n"))
    assert out.where("n > 0").count() == 2 * len(RUNS)


READERS = {
    "md": lambda df: lines.md_units(df, F.lit("en"), "text", "doc_id"),
    "lrc": lambda df: lines.lrc_units(df, F.lit("en"), "text", "doc_id"),
    "srt": lambda df: lines.cue_units(df, F.lit("en"), "text", "doc_id"),
    "ass": lambda df: script_files.ass_units(df, F.lit("en"), "text", "doc_id"),
    "renpy": lambda df: script_files.renpy_units(df, F.lit("en"), "text", "doc_id"),
    "settings": lambda df: trees.setting_units(df, F.lit("en"), "text", "doc_id"),
    "shapes": lambda df: layout.label_shapes(df.select(F.array("text", "text").alias("original_lines"), F.lit("d").alias("domain"))),
}


@pytest.mark.parametrize("name", READERS)
def test_readers(texts, name):
    # some runs end lines, so that a reader's windows hold many rows: fewer of these
    few = texts.withColumn("text", F.when(F.col("text").rlike("^(?:漢字)?[ \r\n]*\n"), F.left("text", F.lit(N // 64))).otherwise(F.col("text")))
    assert READERS[name](few).count() >= 0
