"""A cache of translations fed by a stream: each micro-batch is deduplicated and written as a version of its own; readers take the last version of
each key.

A batch writes as much as it brings, whatever the size of the cache; merging is left to readers, and to compact() from time to time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from unitflow.functions import ids


def upserts(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, key: str = "unit_id", order: str = "updated_at") -> StreamingQuery:
    """Writes the latest row of each key of a batch below path, in a folder whose name is the batch's number. Running a batch again writes the
    same folder again, so a restart repeats nothing."""

    def write(batch: DataFrame, number: int) -> None:
        ids.dedupe_last(batch, key, order).write.mode("overwrite").parquet(f"{path}/v={number:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, key: str = "unit_id") -> DataFrame | None:
    """The rows of the last version of each key below path, null if there is none yet. Keys meet by a partial aggregate, not by a sort of all versions."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c != "v"]
    return rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*names), "v").alias("row")).select("row.*")


def compact(spark: SparkSession, path: str, target: str, key: str = "unit_id") -> None:
    """Writes the merged cache as the one version of another path, from which readers and later batches go on."""
    own = latest(spark, path, key)
    if own is not None:
        own.write.mode("overwrite").parquet(f"{target}/v={0:012d}")
