"""Labels in the first line of a unit, as evidence for layout rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.functions import masks, scripts

# Bounds of a label and of what is a pattern.
MIN_LABEL, MAX_LABEL = 3, 32
MIN_UNITS, MIN_LABELS = 4, 2
SAMPLES = 3
SAMPLE_CHARS = 40


def label_shapes(units: DataFrame) -> DataFrame:
    """open, close, n_units, n_labels, domains and samples of first lines between two different marks. units: original_lines and domain.

    A unit of one line has no label; one that begins with a control has none either.
    """
    first = scripts.trim(F.col("original_lines")[0])
    df = units.where(F.size("original_lines") >= 2).select(first.alias("label"), "domain")
    mark = r"^[^\p{IsAlphabetic}\p{N}\s]$"
    ends = F.left("label", F.lit(1)), F.right("label", F.lit(1))
    fits = F.char_length("label").between(MIN_LABEL, MAX_LABEL) & (ends[0] != ends[1]) & ends[0].rlike(mark) & ends[1].rlike(mark)
    controlled = F.col("label").rlike("^(?:" + "|".join(masks.CORE) + ")")
    df = df.where(fits & ~F.col("label").rlike("[\\n\\r。！？!?]") & ~controlled)
    return df.groupBy(ends[0].alias("open"), ends[1].alias("close")).agg(
        F.count("*").alias("n_units"),
        F.count_distinct("label").alias("n_labels"),
        F.array_join(F.sort_array(F.collect_set("domain")), ",").alias("domains"),
        F.min(F.left("label", F.lit(SAMPLE_CHARS))).alias("sample"),
    )


def propose(shapes: DataFrame) -> DataFrame:
    """Shapes that enough units and labels share."""
    return shapes.where((F.col("n_units") >= MIN_UNITS) & (F.col("n_labels") >= MIN_LABELS))
