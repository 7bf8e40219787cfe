"""Which profile a folder of files is of, and whether a profile may be trusted to write it.

A profile has an extension, signatures that its files show in their first 64 KiB, a reader, and a writer. It is detected where all candidates have the extension, each signature is shown
by some of them, and the reader finds enough units. It is valid where a write without translations gives back every byte, and one with marks puts each mark in its place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD_BYTES = 1 << 16
#: What stands around a text in the trial of a writer.
MARKS = ("⟦", "⟧")


@dataclass(frozen=True)
class Profile:
    """reader(files, source) gives path, location and original_lines; writer(files, done) path and text, done being reader's rows with translation_lines. files: path and text."""

    name: str
    extension: str
    signatures: tuple[str, ...]
    reader: Callable[[DataFrame, Column], DataFrame]
    writer: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    min_units: int = 1


def signature_hits(files: DataFrame, profiles: list[Profile]) -> DataFrame:
    """One row: files, and for each profile the files of its extension (c0, c1 ...) and whether each of its signatures is shown by one of these (s0_0 ...). One
    pass over the first bytes of all files, for all profiles."""
    head = F.substring(F.col("text").cast("binary"), 1, HEAD_BYTES).cast("string")
    own = files.select("path", head.alias("head"))
    columns = [F.count("*").alias("files")]
    for k, p in enumerate(profiles):
        mine = F.lower(F.col("path")).endswith("." + p.extension.lower())
        columns.append(F.count_if(mine).alias(f"c{k}"))
        columns += [F.coalesce(F.bool_or(mine & F.col("head").rlike(s)), F.lit(False)).alias(f"s{k}_{i}") for i, s in enumerate(p.signatures)]
    return own.agg(*columns)


def detected(files: DataFrame, profiles: list[Profile], source: Column) -> list[str]:
    """The names of the profiles whose folder this is, in the order given. Only those whose extension and signatures are met are tried as readers."""
    row = signature_hits(files, profiles).first()
    found = []
    for k, p in enumerate(profiles):
        if row["files"] and row[f"c{k}"] == row["files"] and all(row[f"s{k}_{i}"] for i in range(len(p.signatures))):
            least = max(p.min_units, 1)
            if p.reader(files, source).limit(least).count() == least:
                found.append(p.name)
    return found


def _digest(texts: Column) -> Column:
    """Stands for lists of texts where they are compared, so that only digests are shuffled; each text's own ends with a sign for null."""
    return F.sha2(F.array_join(F.transform(texts, lambda x: F.coalesce(F.sha2(x, 256), F.lit("-"))), ","), 256)


def validated(files: DataFrame, profile: Profile, source: Column) -> DataFrame:
    """path and fault of each file that a profile does not give back: bytes changed by a write without translations, a unit that is lost or moved, or a
    mark that is not in its place. A profile is valid if there are none."""
    own = profile.reader(files, source)
    empty = profile.writer(files, own.withColumn("translation_lines", F.col("original_lines")).limit(0))
    same = files.select("path", F.sha2("text", 256).alias("was")).join(empty.select("path", F.sha2("text", 256).alias("new")), "path", "left")
    changed = same.where(~F.col("was").eqNullSafe(F.col("new"))).select("path", F.lit("a write without translations changes it").alias("fault"))
    marked = F.transform("original_lines", lambda x: F.concat(F.lit(MARKS[0]), x, F.lit(MARKS[1])))
    out = profile.writer(files, own.withColumn("translation_lines", marked))
    again = profile.reader(out.select("path", "text"), source).select("path", "location", _digest(F.col("original_lines")).alias("now"))
    both = own.select("path", "location", _digest(marked).alias("wanted")).join(again, ["path", "location"], "full")
    moved = both.where(~F.col("wanted").eqNullSafe(F.col("now"))).select("path").distinct().select("path", F.lit("a translation is not in its place").alias("fault"))
    return changed.unionByName(moved)


def coverage(files: DataFrame, units: DataFrame) -> DataFrame:
    """files_scanned and files_with_units."""
    with_units = units.select("path").distinct().withColumn("has", F.lit(True))
    return files.select("path").join(with_units, "path", "left").agg(F.count("*").alias("files_scanned"), F.count("has").alias("files_with_units"))
