"""Tables with versions, changed all at once or not at all.

A version is a manifest that names a folder of files for each table. A change writes new folders first, then its manifest, which one rename
publishes under the next number: readers see the tables of one version, a write that fails or is killed publishes nothing, and of two writers of the same version the
second is refused. Folders that no manifest names are taken away by vacuum(). Everything goes through Hadoop's file systems, so a workspace lies in any store that Spark writes to.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitflow.operators import review, store

UNITS, TRANSLATIONS = "units", "translations"


class Conflict(RuntimeError):
    """Another version was published since a change began."""


class Refused(ValueError):
    """Records that are not imported: how many for each reason."""

    def __init__(self, reasons: dict[str, int]):
        super().__init__("; ".join(f"{n} x {r}" for r, n in sorted(reasons.items())))
        self.reasons = reasons


class Workspace:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("x").getFileSystem(self._conf)

    def _listed(self, name: str) -> list[str]:
        fs = self._files()
        return sorted(s.getPath().getName() for s in fs.listStatus(self._at(name))) if fs.exists(self._at(name)) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._listed("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """Tables and facts of a version, the last if none is named; of an empty workspace nothing, as version 0."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version not in (0, *known):
            raise ValueError(f"no version {version}")
        if version == 0:
            return {"version": 0, "tables": {}, "facts": {}}
        stream = self._files().open(self._at(f"manifests/{version:012d}.json"))
        try:
            return {"version": version, **json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))}
        finally:
            stream.close()

    def table(self, name: str, version: int | None = None) -> DataFrame | None:
        folder = self.manifest(version)["tables"].get(name)
        return None if folder is None else self.spark.read.parquet(f"{self.path}/{folder}")

    def commit(self, changes: dict[str, DataFrame], facts: dict | None = None, since: int | None = None) -> int:
        """Writes the tables of a change and publishes them with all others as the next version, whose number it gives. since: the version that
        the change was made from; a later one refuses it."""
        before = self.manifest()
        if since is not None and before["version"] != since:
            raise Conflict(f"version {before['version']} was published after {since}")
        folders = {}
        for name, df in changes.items():
            folders[name] = f"data/{name}-{uuid.uuid4().hex}"
            df.write.option("compression", "zstd").parquet(f"{self.path}/{folders[name]}")
        body = json.dumps({"tables": before["tables"] | folders, "facts": before["facts"] | (facts or {})}, sort_keys=True)
        return self._publish(before["version"] + 1, body)

    def _publish(self, version: int, body: str) -> int:
        fs, part = self._files(), self._at(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(part, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(part, self._at(f"manifests/{version:012d}.json"), options)
        except Exception as e:
            fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} was published meanwhile") from e
            raise
        return version

    def vacuum(self, keep: int = 1) -> int:
        """Takes away all but the last versions, and the folders that these don't name; gives the number of folders. Not beside writers."""
        known = self.versions()
        kept = known[-keep:]
        named = {f.removeprefix("data/") for v in kept for f in self.manifest(v)["tables"].values()}
        fs, gone = self._files(), 0
        for v in known[: len(known) - len(kept)]:
            fs.delete(self._at(f"manifests/{v:012d}.json"), False)
        for folder in self._listed("data"):
            if folder not in named:
                fs.delete(self._at(f"data/{folder}"), True)
                gone += 1
        return gone


def replace_units(ws: Workspace, units: DataFrame, snapshot: str, dry_run: bool = False) -> int:
    """All units anew, translations of units that are gone or have another source purged, and the snapshot of the source, as one version. A
    dry run publishes nothing and gives the number of the version as it is."""
    now = ws.manifest()
    if dry_run:
        return now["version"]
    changes = {UNITS: units}
    if (old := ws.table(TRANSLATIONS, now["version"])) is not None:
        changes[TRANSLATIONS] = store.purge(old, units)
    return ws.commit(changes, {"snapshot": snapshot}, now["version"])


def save_translations(ws: Workspace, batch: DataFrame, dry_run: bool = False) -> int:
    """A batch of translations in place of older ones of the same units, as one version."""
    now = ws.manifest()
    if dry_run:
        return now["version"]
    old = ws.table(TRANSLATIONS, now["version"])
    return ws.commit({TRANSLATIONS: batch if old is None else store.upsert(old, batch, "unit_id")}, None, now["version"])


def judged(records: DataFrame, units: DataFrame) -> DataFrame:
    """records (id, text, lines) with unit_id, source_hash and fault, the first of each record or null. A record names a unit by its location or else by its
    id. units: id, location, item_type, source_hash, original_lines. Records without lines are only looked up."""
    own = ["id", "location", "item_type", "source_hash", "original_lines"]
    unit = F.struct(*own)
    by_location = units.groupBy(F.col("location").alias("__place")).agg(F.max_by(unit, F.col("id")).alias("here"))
    # a unit whose id is its location is found by that, or another in its place is
    by_id = units.where(~F.col("id").eqNullSafe(F.col("location"))).groupBy(F.col("id").alias("__place")).agg(F.max_by(unit, F.col("location")).alias("named"))
    df = records.join(by_location, records["id"] == F.col("__place"), "left").drop("__place").join(by_id, records["id"] == F.col("__place"), "left").drop("__place")
    df = df.withColumn("unit", F.coalesce("here", "named")).drop("here", "named")
    seen = df.where("unit is not null").groupBy(F.col("unit.id").alias("unit_id")).agg(F.count("*").alias("n"))
    df = df.withColumn("unit_id", F.col("unit.id")).join(seen, "unit_id", "left")
    df = df.select("id", "text", "lines", "unit_id", "n", F.col("unit.source_hash").alias("source_hash"), F.col("unit.item_type").alias("item_type"), F.coalesce("unit.original_lines", F.array().cast("array<string>")).alias("original_lines"))
    full = F.coalesce(F.size("lines") > 0, F.lit(False))
    masked = review.with_masks(df.withColumn("given", F.col("lines")).withColumn("lines", F.when(full, F.col("lines")).otherwise(F.col("original_lines"))))
    fault = _first(
        (F.col("unit_id").isNull(), "unknown id"),
        (F.col("text") != F.array_join("original_lines", "\n"), "another source text"),
        (F.col("n") > 1, "more than one record"),
        (full & review.structure_error(F.col("item_type"), F.col("original_lines"), F.col("lines")).isNotNull(), "another structure"),
        (full & (F.col("lost_core") > 0), "a literal is lost"),
    )
    return masked.select("id", "text", F.col("given").alias("lines"), "unit_id", "source_hash", fault.alias("fault"))


def _first(*faults: tuple[Column, str]) -> Column:
    return F.coalesce(*(F.when(test, F.lit(name)) for test, name in faults))


def import_records(ws: Workspace, records: DataFrame, dry_run: bool = False) -> int:
    """Translations from records, all of them or, with Refused, none; gives how many. Records without lines are skipped."""
    now = ws.manifest()
    found = judged(records, ws.table(UNITS, now["version"]))
    reasons = {r.fault: r.n for r in found.where("fault is not null").groupBy("fault").agg(F.count("*").alias("n")).collect()}
    if reasons:
        raise Refused(reasons)
    batch = found.where(F.size("lines") > 0).select("unit_id", "source_hash", "lines", F.lit(False).alias("passthrough"))
    n = batch.count()
    if n and not dry_run:
        old = ws.table(TRANSLATIONS, now["version"])
        ws.commit({TRANSLATIONS: batch if old is None else store.upsert(old, batch, "unit_id")}, None, now["version"])
    return n
