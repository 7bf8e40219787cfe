"""One read of a folder of files of any formats.

Every file is opened once, where Spark finds it: decoded, and claimed by the first format that takes it. The data folder of a game claims its
files before all others, then extensions tell, then the contents of JSON, then the scanners for files of no declared format. Claims are
written by format, so a reader opens the files of its own format alone, and of these the columns it needs; all readers' units have the same columns.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitflow.functions.written import written_by
from unitflow.sources import archives, games, scripts, spans, tables
from unitflow.sources.files import READERS, decoded

ARCHIVES = ("epub", "docx", "xlsx")
GAME, AUTO, NONE = "rmmz", "auto", "none"
#: The format of an extension, where it isn't its own name.
ALIASES = {"vtt": "srt", "ssa": "ass", "pot": "po", "htm": "html", "markdown": "md", "xhtml": "html"}
COLUMNS = ("path", "engine", "id", "domain", "location", "context", "item_type", "role", "original_lines")
#: Game folders whose names are sent to the executors.
SENT_FOLDERS = 1 << 14
_CLAIM = "path string, name string, engine string, encoding string, text string, content binary"


def claim(path: str, content: bytes | None) -> tuple[str, str, str | None, bytes | None]:
    """(engine, encoding, text, content) of a file that is no game's: text for what is text, content for archives."""
    extension = posixpath.splitext(path)[1][1:].lower()
    if extension in ARCHIVES:
        return extension, "binary", None, content
    text, encoding = decoded(content or b"")
    if text is None:
        return NONE, encoding, None, None
    if extension == "json":
        shape = tables.json_shape(text)
        engine = shape or (AUTO if spans.scan(text, path)[0] else NONE)
    elif extension == "jsonl" or extension in READERS:
        engine = ALIASES.get(extension, extension)
    else:
        engine = ALIASES.get(extension) or (AUTO if spans.scan(text, path)[0] else NONE)
    return engine, encoding, text, None


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]*$", "")


def claimed(files: DataFrame) -> DataFrame:
    """path, name, engine, encoding, text and content of each file (path and content), written by engine. In a folder with the system file and
    another data file of a game, all its data files are the game's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                own = path.as_py()
                engine, encoding, text, data = claim(own, content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((own, posixpath.basename(own), engine, encoding, text, data), (*[pa.string()] * 5, pa.binary()), strict=True)], names=[f.split()[0] for f in _CLAIM.split(", ")])

    data_file = F.col("path").rlike(r"(?:^|/)(?:System|CommonEvents|Troops|Map[0-9]{3}|" + "|".join(games.DATABASE) + r")\.json$")
    system = F.col("path").rlike(r"(?:^|/)System\.json$")
    folders = files.where(data_file).groupBy(_folder(F.col("path")).alias("__folder")).agg(F.bool_or(system).alias("system"), F.count("*").alias("n")).where("system and n > 1").select("__folder")
    n = folders.limit(SENT_FOLDERS + 1).count()
    df = files.select("path", "content").mapInArrow(run, _CLAIM)
    if n:
        known = folders.withColumn("__game", F.lit(True))
        df = df.withColumn("__folder", _folder(F.col("path"))).join(F.broadcast(known) if n <= SENT_FOLDERS else known, "__folder", "left")
        df = df.withColumn("engine", F.when(F.col("__game") & data_file, GAME).otherwise(F.col("engine"))).drop("__folder", "__game")
    return written_by(df, "claims", "engine")


def _game(df: DataFrame, source: Column) -> DataFrame:
    own = df.withColumn("folder", _folder(F.col("path")))
    out = games.game_units(own, source, "name", "text", "folder")
    return out.withColumn("path", F.concat("folder", F.substring_index("location", "/", 1)))


def _reader(engine: str, df: DataFrame, source: Column) -> DataFrame | None:
    if engine == GAME:
        return _game(df, source)
    if engine in ARCHIVES:
        return archives.archive_units(df, source, engine, "content", "path")
    if engine in ("mtool", "paratranz", "vnt"):
        return scripts.json_list_units(df, source, engine, "text", "path")
    if engine == "jsonl":
        return tables.jsonl_units(df, "text", "path")
    if engine == AUTO:
        out = spans.span_units(df.select(F.col("path").alias("file"), "text"), source)
        return out.withColumnRenamed("file", "path").withColumn("domain", F.col("format")).withColumn("context", F.col("path")).withColumn("item_type", F.lit("long_text"))
    known = READERS.get("json" if engine == "i18next" else engine)
    return None if known is None else known(df, source, "text", "path")


def units_of(claims: DataFrame, source: str | Column, *engines: str) -> DataFrame:
    """The units of claimed files, of all engines or some: COLUMNS, empty where a format has no such thing."""
    source = F.lit(source) if isinstance(source, str) else source
    present = engines or tuple(sorted(r.engine for r in claims.select("engine").distinct().collect()))  # one row for each format
    out = None
    for engine in present:
        found = _reader(engine, claims.where(F.col("engine") == engine).drop("engine"), source)
        if found is None:
            continue
        found = found.drop("engine").withColumn("engine", F.lit(engine))
        own = found.select(*(F.col(c) if c in found.columns else F.lit("").alias(c) for c in COLUMNS))
        out = own if out is None else out.unionByName(own)
    if out is None:
        return claims.sparkSession.createDataFrame([], "path string, engine string, id string, domain string, location string, context string, item_type string, role string, original_lines array<string>")
    return out


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of all files below a path; hidden ones are left out, and empty ones, which hold no unit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.where(~F.col("path").rlike(r"/[._][^/]*$"))


def read_folder(spark: SparkSession, path: str, source: str | Column, *engines: str) -> DataFrame:
    """The units of all files below a path, whatever their formats."""
    return units_of(claimed(binary_files(spark, path)), source, *engines)


def coverage(claims: DataFrame, units: DataFrame) -> DataFrame:
    """engine, files, files_with_units and units; files that no format takes have the engine none."""
    own = units.groupBy("path").agg(F.count("*").alias("n"))
    return claims.select("path", "engine").join(own, "path", "left").groupBy("engine").agg(F.count("*").alias("files"), F.count("n").alias("files_with_units"), F.sum(F.coalesce("n", F.lit(0))).alias("units"))
