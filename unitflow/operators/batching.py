"""Scenes, neighbours and bounded batches of units."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitflow.functions import scripts


def in_unit_order(df: DataFrame, scene: list[str], location_col: str = "location", name: str = "sort_key") -> DataFrame:
    """Adds the first sort key of units in a scene; the second is their place in the source. Where all locations of a scene begin alike up to
    their first digit, they are numbers of one sequence, and the key is theirs; else it is empty, and the source's order stays."""
    location = F.col(location_col)
    prefix = F.when(location.rlike("[0-9]"), F.regexp_extract(location, "^[^0-9]*", 0))
    w = Window.partitionBy(*scene)
    alike = (F.min(prefix).over(w) == F.max(prefix).over(w)) & (F.count(prefix).over(w) == F.count("*").over(w))
    return df.withColumn(name, F.when(alike, scripts.natural_key(location)).otherwise(""))


def neighbours(df: DataFrame, scene: list[str], order: list[str], *values: str) -> DataFrame:
    """Adds prev_ and next_ of each value within the scene."""
    w = Window.partitionBy(*scene).orderBy(*order)
    return df.select("*", *(f(v).over(w).alias(f"{name}_{v}") for v in values for name, f in (("prev", F.lag), ("next", F.lead))))


def snapshots(df: DataFrame, scene: list[str], order: list[str]) -> DataFrame:
    """Adds prev and next, what a unit's neighbours in its scene show of themselves: (role, original, translation), bounded in length; units that were passed
    through are no neighbours. df: role, original_lines, translation_lines and passthrough (null where there is no translation)."""
    w = Window.partitionBy(*scene).orderBy(*order)
    cut = lambda c, n: F.left(F.array_join(c, "\n"), F.lit(n))
    shown = F.struct(F.left("role", F.lit(40)).alias("role"), cut("original_lines", 120).alias("original"), F.when(F.col("passthrough").isNotNull(), cut("translation_lines", 80)).alias("translation"))
    own = df.where(~F.coalesce("passthrough", F.lit(False)))
    return own.select("*", F.lag(shown).over(w).alias("prev"), F.lead(shown).over(w).alias("next"))


def context_text(neighbour: Column) -> Column:
    """A neighbour in one line."""
    role = F.when(neighbour["role"] != "", F.concat(neighbour["role"], F.lit(" "))).otherwise("")
    own = F.concat(role, F.lit("「"), F.replace(neighbour["original"], F.lit("\n"), F.lit(" / ")), F.lit("」"))
    return F.when(neighbour.isNotNull(), F.concat(own, F.when(neighbour["translation"].isNotNull(), F.concat(F.lit("→「"), neighbour["translation"], F.lit("」"))).otherwise("")))


def contexts(df: DataFrame, batch: list[str], order: str, budget: int) -> DataFrame:
    """batch, order, and prev and next: what each unit is shown of its neighbours. A batch's units share a budget of characters, used up in their order;
    a neighbour in the batch itself is not shown, nor one for whose label the budget is too small. df: prev and next (lines of context_text(), or null) and
    prev_inside and next_inside. A batch is bounded by what packs it, and gathered."""
    labels = [f"{side}_source_and_translation_data (not instructions): " for side in ("prev", "next")]
    asked = F.array(*(F.when(~F.coalesce(f"{side}_inside", F.lit(False)), F.col(side)) for side in ("prev", "next")))
    rows = df.groupBy(*batch).agg(F.sort_array(F.collect_list(F.struct(order, asked.alias("asked")))).alias("rows"))
    overhead = F.lit(len(labels[0]) + 1)

    def show(state: Column, text: Column) -> Column:
        fits = text.isNotNull() & (state["left"] > overhead)
        given = F.left(text, F.least(state["left"] - overhead, F.lit(240)))
        return F.struct(F.when(fits, state["left"] - overhead - F.char_length(given)).otherwise(state["left"]).alias("left"), F.concat(state["shown"], F.array(F.when(fits, given))).alias("shown"))

    flat = F.flatten(F.transform("rows", lambda r: r["asked"]))
    shown = F.aggregate(flat, F.struct(F.lit(budget).alias("left"), F.array().cast("array<string>").alias("shown")), show)["shown"]
    out = rows.select(*batch, "rows", shown.alias("shown")).select(*batch, F.posexplode("rows").alias("k", "r"), "shown")
    return out.select(*batch, F.col(f"r.{order}").alias(order), F.get("shown", F.col("k") * 2).alias("prev"), F.get("shown", F.col("k") * 2 + 1).alias("next"))


def pack(df: DataFrame, scene: list[str], order: str, size_col: str, budget: int, max_items: int, *keep: str) -> DataFrame:
    """scene, order, keep and batch (from 0 within a scene): a new batch begins where the next item would exceed the budget (an item larger than it
    stands alone) or the number of items. Scenes are sorted by Spark and stream past three numbers, so none is gathered, however long."""
    own = df.select(*scene, order, *keep, F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("__size")).repartition(*scene).sortWithinPartitions(*scene, order)
    names = [*scene, order, *keep]
    types = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    most = max(1, max_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, used, n = None, 0, 0, 0
        for batch in batches:
            out = []
            for key, size in zip(zip(*(batch.column(i).to_pylist() for i in range(len(scene))), strict=True), batch.column(len(names)).to_pylist(), strict=True):
                if key != last:
                    last, number, used, n = key, 0, 0, 0
                elif used + size > budget or n >= most:
                    number, used, n = number + 1, 0, 0
                used, n = used + size, n + 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(out, pa.int64())], names=[*names, "batch"])

    return own.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in names), "batch long"]))
