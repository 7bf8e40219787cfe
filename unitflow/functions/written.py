"""Intermediate results as files that outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, set here only where it is unset and all of Spark is one process."""
    try:
        found = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # an older session refuses core settings
        found = None
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="unitflow-")  # one machine without a setting, as in tests
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the shared folder and reads it back: cuts the lineage at files that outlive an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/unitflow/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """Like written(), in a folder for each value of a column, which stands last: who asks for one value opens its files alone."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/unitflow/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(column).parquet(path)
    rest = [f for f in df.schema.fields if f.name != column]
    return spark.read.schema(StructType([*rest, df.schema[column]])).parquet(path)
