"""Helpers that several corpus operators use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitflow.functions.written import shared_dir, written

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACE = r"[\x20\x09-\x0D]+"


#: Buckets of a written table; Spark takes at most 100,000.
MAX_BUCKETS = 20_000


def words_of(text: str) -> list[bytes]:
    """The words of a text in UTF-8: bytes split at just these blanks, where str.split() also splits at others."""
    return text.encode().split()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


materialize = written


def materialize_by(df: DataFrame, name: str, column: str, n: int) -> DataFrame:
    """Like materialize(), in n buckets of a column, or MAX_BUCKETS, each of which then holds several: what groups by it later reads the
    files without a shuffle. The catalog's entry, which only tells Spark of the buckets, goes again at once; the files stay."""
    spark, table = df.sparkSession, f"unitflow_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/unitflow/{table}").bucketBy(min(n, MAX_BUCKETS), column).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolves the plan
    spark.sql(f"DROP TABLE {table}")
    return out


def chunked(lengths, limit: int):
    """Ranges (start, end) of consecutive rows whose lengths sum to limit at most; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def free_name(df: DataFrame, name: str) -> str:
    """A name for a working column that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads; other columns, whatever their names, cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
