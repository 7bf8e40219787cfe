"""Files as rows of text, and the reader for each format by name or by extension."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitflow.sources import lines, markup, scripts, tables
from unitflow.sources.encodings import legacy

MARKS = ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))

Reader = Callable[..., DataFrame]
READERS: dict[str, Reader] = {
    "txt": lines.txt_units,
    "md": lines.md_units,
    "srt": lines.cue_units,
    "vtt": lines.cue_units,
    "lrc": lines.lrc_units,
    "ass": scripts.ass_units,
    "ssa": scripts.ass_units,
    "rpy": scripts.renpy_units,
    "csv": tables.csv_units,
    "tsv": lambda df, source, text, *keep: tables.csv_units(df, source, text, *keep, delimiter="\t"),
    "po": tables.po_units,
    "pot": tables.po_units,
    "html": markup.html_units,
    "htm": markup.html_units,
    "json": tables.json_units,
}


def decoded(content: bytes) -> tuple[str | None, str]:
    """(text, encoding): strict UTF-8, UTF-16 by its mark, then the legacy encoding under which its characters are the likeliest. Null for what looks binary."""
    if content.startswith(b"\xef\xbb\xbf"):
        content = content[3:]
    for mark, name in MARKS:
        if content.startswith(mark):
            return content[2:].decode(name, "replace"), name
    try:
        return content.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass
    if b"\0" in content:
        return None, "binary"
    return legacy(content) or (content.decode("utf-8", "replace"), "utf-8")


def texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, text and encoding of each file below a path; found and read by Spark, hidden files left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [decoded(c) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in pairs], pa.string()), pa.array([e for _, e in pairs], pa.string())], names=["path", "text", "encoding"])

    return files.where(~F.col("path").rlike(r"/[._][^/]*$")).mapInArrow(run, "path string, text string, encoding string")


def read_units(spark: SparkSession, path: str, source: str | Column, engine: str) -> DataFrame:
    """Units of all files of one format below a path: path, id, location, context and original_lines."""
    if engine not in READERS:
        raise ValueError(f"unknown format {engine!r}; one of {', '.join(READERS)}")
    found = READERS[engine](texts(spark, path, f"*.{engine}"), F.lit(source) if isinstance(source, str) else source, "text", "path")
    return found.select("path", "id", "location", "context", "original_lines")


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, READERS[k].__module__.rsplit(".", 1)[-1]) for k in READERS], "format string, family string")
