"""Translation by a callable that is handed in: batches of units go to it in tasks, what it gets wrong goes again in smaller batches.

The callable takes a list of texts with masks in place of literals and returns as many texts, or fewer; it may raise. Nothing here knows a
network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitflow.functions import masks

Translator = Callable[[list[str]], list[str]]
SCHEMA = "id string, target string, error string"


def _checked(text: str, done: str | None) -> tuple[str | None, str | None]:
    """(the accepted text, None) or (None, what is wrong with it)."""
    if done is None:
        return None, "no row"
    literals = masks.mask_lines([text])[1]
    out = masks.unmask_line(done, literals)
    if not out.strip():
        return None, "empty"
    return (None, "literals lost") if masks.lost_tokens([out], literals) else (out, None)


def attempt(units: DataFrame, translator: Translator) -> DataFrame:
    """id, target and error of each unit. units: id, text and batch; a task hands each batch to the translator once."""

    def run(table: pa.Table) -> pa.Table:
        ids, texts = table.column("id").to_pylist(), table.column("text").to_pylist()
        try:
            done = translator([masks.mask_lines([t])[0][0] for t in texts])
            rows = [_checked(t, done[k] if k < len(done) else None) for k, t in enumerate(texts)]
        except Exception as e:  # the translator's own failure is an answer
            rows = [(None, f"failed: {e}")] * len(texts)
        return pa.table({"id": ids, "target": pa.array([t for t, _ in rows], pa.string()), "error": pa.array([e for _, e in rows], pa.string())})

    return units.groupBy("batch").applyInArrow(run, SCHEMA)


def translate(units: DataFrame, translator: Translator, save: Callable[[DataFrame, str], DataFrame], width: int = 6, attempts: int = 4) -> DataFrame:
    """id, target, passthrough and error of every unit (id, scene, ordinal, text). Rejected units go again in batches half as wide, and are passed through in the end.

    save(df, name) writes a DataFrame where all executors read it and returns it read again; each attempt is saved once.
    """
    left, answers = units, None
    for n in range(attempts):
        place = F.row_number().over(Window.partitionBy("scene").orderBy("ordinal", "id")) - 1
        batched = left.withColumn("batch", F.concat_ws("/", "scene", F.floor(place / max(1, width >> n)).cast("string")))
        got = save(attempt(batched.select("id", "text", "batch"), translator), f"attempt-{n}")
        good = got.where("error is null").withColumn("passthrough", F.lit(False))
        answers = good if answers is None else answers.unionByName(good)
        bad = got.where("error is not null")
        if n == attempts - 1 or bad.isEmpty():
            return answers.unionByName(bad.withColumn("passthrough", F.lit(True)))
        left = left.join(bad.select("id"), "id", "left_semi")
    raise ValueError("no attempts")
