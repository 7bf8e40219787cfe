"""Rows of Arrow batches taken in small pieces, so that what a task's Python worker holds as objects does not grow with a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of a piece; a row that is larger is a piece of its own.
ROWS, BYTES = 256, 1 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ROWS rows, of about BYTES."""
    step = max(1, min(ROWS, BYTES * batch.num_rows // max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def added(df: DataFrame, inputs: list[str], columns: dict[str, tuple[str, pa.DataType]], f: Callable[..., tuple]) -> DataFrame:
    """df with columns (name: its type for Spark and for Arrow) that f gives for the inputs of each row."""
    types = {x.name: x.dataType.simpleString() for x in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                rows = [f(*r) for r in zip(*(piece.column(c).to_pylist() for c in inputs), strict=True)]
                made = [pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), columns.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *made], names=[*types, *columns])

    return df.mapInArrow(run, ", ".join([*(f"`{k}` {t}" for k, t in types.items()), *(f"`{k}` {t}" for k, (t, _) in columns.items())]))
