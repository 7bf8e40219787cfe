"""Tabular, catalogue and JSON sources: units from delimited files, gettext catalogues, JSON trees and JSON lines.

Each parser is a plain function of one text; Spark runs it where the files' rows lie, a batch at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.functions import ids, scripts

MAX_DEPTH = 128
#: How much text, or how many rows, a task's worker gathers before it hands on what it has parsed.
OUT_CHARS, OUT_ROWS = 1 << 20, 1 << 12


def exploded(df: DataFrame, text_col: str, keep: tuple[str, ...], schema: str, parse: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """keep and the columns of schema for each row that parse gives for a text; a text it refuses with ValueError gives none."""
    own = df.select(*keep, F.col(text_col).alias("__text"))
    types = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    whole = ", ".join([*(f"`{k}` {types[k]}" for k in keep), schema])
    kinds = {"long": pa.int64(), "string": pa.string()}
    arrow = [kinds[c.strip().split(" ")[1]] for c in schema.split(",")]

    def packed(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keep))), *(pa.array(c, t) for c, t in zip(columns, arrow, strict=True))], names=[*keep, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, size = [], [], 0
            for k in range(batch.num_rows):
                text = batch.column(len(keep))[k].as_py() or ""
                try:
                    found = list(parse(text))
                except ValueError:
                    continue
                at += [k] * len(found)
                rows += found
                size += len(text)
                if size >= OUT_CHARS or len(rows) >= OUT_ROWS:  # rows of a few texts at a time, not of a whole batch
                    yield packed(batch, at, rows)
                    at, rows, size = [], [], 0
            if rows:
                yield packed(batch, at, rows)

    return own.mapInArrow(run, whole)


def csv_spans(text: str, delimiter: str = ",") -> Iterator[tuple[int, int, list[str]]]:
    """(start, end without its line end, fields) of each record. A field that begins with a quote ends at its closing quote, doubled quotes inside are
    one; quotes elsewhere are themselves. Records end at a line feed, with or without a carriage return before it."""
    fields, at, n, start = [], 0, len(text), 0
    while at < n:
        value = ""
        while at < n and text[at] == '"' and not value:  # quoted parts; an empty one may be followed by another
            close = at + 1
            while (close := text.find('"', close)) >= 0 and text[close + 1 : close + 2] == '"':
                close += 2
            stop = n if close < 0 else close
            value, at = text[at + 1 : stop].replace('""', '"'), min(stop + 1, n)
        stop = min((p for p in (text.find(delimiter, at), text.find("\n", at)) if p >= 0), default=n)
        ends = stop < n and text[stop] == "\n"
        bare = stop - 1 if ends and stop > at and text[stop - 1] == "\r" else stop
        value += text[at:bare]
        fields.append(value)
        at = stop + 1
        if ends or stop == n:
            if stop < n or value or len(fields) > 1:
                yield start, bare, fields
            fields, start = [], at
        elif at == n:  # a delimiter at the very end
            yield start, n, [*fields, ""]
            fields = []


def csv_records(text: str, delimiter: str = ",") -> list[list[str]]:
    """Fields of each record."""
    return [fields for _, _, fields in csv_spans(text, delimiter)]


def csv_units(df: DataFrame, source: Column, text_col: str = "text", *keep: str, delimiter: str = ",") -> DataFrame:
    """A unit for each cell in the source language, at row and field from 0."""

    def cells(text: str) -> Iterator[tuple]:
        for r, fields in enumerate(csv_records(text, delimiter)):
            for c, value in enumerate(fields):
                yield r, c, value

    own = exploded(df, text_col, keep, "row long, field long, cell string", cells).where(scripts.needs_translation(F.col("cell"), source))
    own = own.withColumn("location", F.concat(F.format_string("r%06d/", "row"), F.col("field").cast("string"))).withColumn("context", F.format_string("s%04d", F.floor(F.col("row") / 40)))
    own = own.withColumn("original_lines", F.split("cell", "\n")).withColumn("item_type", F.when(F.size("original_lines") > 1, "long_text").otherwise("short_text"))
    return own.withColumn("id", ids.unit_id(F.lit("csv"), F.col("location"), F.col("original_lines"))).drop("cell")


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def _unescaped(text: str) -> str:
    out, at = [], 0
    while (p := text.find("\\", at)) >= 0:
        out.append(text[at:p])
        out.append(_ESCAPES.get(text[p + 1 : p + 2], text[p : p + 2]))
        at = p + 2
    return "".join(out) + text[at:]


def po_entries(text: str) -> Iterator[tuple[int, str]]:
    """(number, msgid) of each entry of a gettext catalogue, without the header and entries of plural forms. All entries are numbered."""
    blocks, now = [], []
    for line in [*text.split("\n"), ""]:
        line = line.strip()
        if line:
            now.append(line)
        elif now:
            blocks.append(now)
            now = []
    for number, block in enumerate(blocks):
        ident, plural, inside, translated = [], False, False, False
        for line in block:
            word = line.split('"', 1)[0].strip()
            quoted = line[line.find('"') :] if '"' in line else ""
            if line.startswith("#"):
                inside = False
            elif word or not quoted:
                plural |= word == "msgid_plural"
                translated |= word.startswith("msgstr")
                inside = word == "msgid"
            if inside and len(quoted) > 1 and quoted.endswith('"'):
                ident.append(quoted[1:-1])
        if ident and "".join(ident) and translated and not plural:
            yield number, _unescaped("".join(ident))


def po_units(df: DataFrame, source: Column, text_col: str = "text", *keep: str) -> DataFrame:
    own = exploded(df, text_col, keep, "entry long, msgid string", po_entries).where(scripts.needs_translation(F.col("msgid"), source))
    own = own.withColumn("location", F.format_string("e%05d", "entry")).withColumn("context", F.format_string("s%04d", F.floor(F.col("entry") / 40))).withColumn("original_lines", F.split("msgid", "\n"))
    return own.withColumn("id", ids.unit_id(F.lit("po"), F.col("location"), F.col("original_lines"))).drop("msgid")


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def json_leaves(text: str, slashes: bool = True) -> Iterator[tuple[int, str, str | None, str]]:
    """(number, path, string or null, kind) of each leaf in order; numbers count string leaves. Constants that JSON lacks are refused, and nesting
    deeper than MAX_DEPTH. Without slashes, what stands under a key that holds one is passed over: its path would not be its own."""
    try:
        root = json.loads(text, parse_constant=_refuse)
    except RecursionError as e:
        raise ValueError("too deep") from e
    stack, number, out = [("", root, 0)], 0, []
    while stack:
        path, value, depth = stack.pop()
        if depth > MAX_DEPTH:
            raise ValueError("too deep")
        if isinstance(value, dict):
            stack += [(f"{path}/{k}" if path else k, v, depth + 1) for k, v in reversed(value.items()) if slashes or "/" not in k]
        elif isinstance(value, list):
            stack += [(f"{path}/{k}" if path else str(k), v, depth + 1) for k, v in reversed(list(enumerate(value)))]
        elif isinstance(value, str):
            out.append((number, path, value, "string"))
            number += 1
        else:
            out.append((-1, path, None, "null" if value is None else "boolean" if isinstance(value, bool) else "number"))
    return iter(out)


def json_keys(text: str) -> Iterator[tuple[int, str]]:
    """(number, key) of each key of an object, in order, of any length, those that are there twice too; none for what is no object."""
    try:
        root = json.loads(text, parse_constant=_refuse, object_pairs_hook=_Pairs)
    except RecursionError as e:
        raise ValueError("too deep") from e
    return enumerate(k for k, _ in root) if isinstance(root, _Pairs) else iter(())


class _Pairs(list):
    """The pairs of an object, told apart from a list."""


def json_units(df: DataFrame, source: Column, text_col: str = "text", *keep: str) -> DataFrame:
    """A unit for each string leaf in the source language, at its path; scenes of fifty string leaves. Keys with a slash are passed over."""
    own = exploded(df, text_col, keep, "leaf long, location string, value string, kind string", partial(json_leaves, slashes=False))
    own = own.where((F.col("kind") == "string") & scripts.needs_translation(F.col("value"), source)).withColumn("context", F.format_string("s%04d", F.floor(F.col("leaf") / 50)))
    own = own.withColumn("original_lines", F.split("value", "\n"))
    return own.withColumn("id", ids.unit_id(F.lit("i18next"), F.col("location"), F.col("original_lines"))).drop("value", "kind")


def json_shape(text: str | None) -> str | None:
    """Which exchange format a JSON text is in, by its contents: paratranz, vnt, mtool, i18next or none of them."""
    try:
        root = json.loads(text or "", parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    if isinstance(root, list):
        first = root[0] if root and isinstance(root[0], dict) else {}
        return "paratranz" if "original" in first and "key" in first else "vnt" if "message" in first else None
    if not isinstance(root, dict):
        return None
    if root and all(isinstance(v, str) for v in root.values()):
        equal = sum(k == v for k, v in root.items())
        if equal * 10 >= len(root) * 3 or any(_JAPANESE.search(k) for k in root):
            return "mtool"
    strings = others = 0
    left = [root]
    while left:
        value = left.pop()
        if isinstance(value, (dict, list)):
            left += value.values() if isinstance(value, dict) else value
        else:
            strings, others = strings + isinstance(value, str), others + (not isinstance(value, str))
    return "i18next" if strings and strings * 5 >= (strings + others) * 4 else None


_JAPANESE = re.compile("[\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f]")


def json_shapes(text: Column) -> Column:
    """json_shape() of a column, one Arrow batch at a time."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(json_shape)

    return run(text)


#: Fixed value: the role of a record without one.
NARRATOR = "旁白"


def jsonl_units(df: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """A unit for each record of JSON lines; of records of the same id and text the first. A line that is no record of id and text fails the read."""

    def records(text: str) -> Iterator[tuple]:
        seen = set()
        for k, line in enumerate(text.split("\n"), 1):
            if line.strip():
                r = json.loads(line, parse_constant=_refuse)
                if not isinstance(r, dict) or not isinstance(r.get("text"), str) or not isinstance(r.get("id"), str):
                    raise TypeError(f"line {k} has no id and text")
                location = r["id"] or f"line:{k}"
                if (location, r["text"]) not in seen:
                    seen.add((location, r["text"]))
                    yield k, location, r["text"], r.get("context") or "", r.get("role") or NARRATOR, r.get("item_type") or "long_text"

    own = exploded(df, text_col, keep, "line long, location string, value string, context string, role string, item_type string", records)
    own = own.withColumn("original_lines", F.split("value", "\n"))
    return own.withColumn("id", ids.unit_id(F.lit("jsonl"), F.col("location"), F.col("original_lines"))).drop("value")
