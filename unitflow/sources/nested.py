"""Texts in JSON that lies in strings of JSON, to any depth, and their translations put back at the same depth.

A string that is itself an object, a list or a string of JSON is opened, again and again until none is; a path says with an exclamation mark where a
string was opened. A write opens the strings on its way, puts the text in, and closes each again as it was written; what lies beside the way keeps its bytes
within each string.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.functions import batches, ids, prose, scripts
from unitflow.sources.tables import exploded

MAX_OPENED = 16
OPENED = "!"
_STYLES = ((",", ":"), (", ", ": "))


def opened(text: str):
    """(value, True) of a string that is an object, a list or a string of JSON, else (text, False)."""
    if text.strip()[:1] not in ("{", "[", '"'):
        return text, False
    try:
        value = json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return text, False
    return (value, True) if isinstance(value, (dict, list, str)) else (text, False)


def _refuse(name: str):
    raise ValueError(name)


def closed(value, like: str) -> str:
    """A value as JSON in the manner of the string that it was opened from, if one of the two common manners is that."""
    before = json.loads(like)
    for plain in (False, True):
        for style in _STYLES:
            if json.dumps(before, ensure_ascii=plain, separators=style) == like:
                return json.dumps(value, ensure_ascii=plain, separators=style)
    return json.dumps(value, ensure_ascii=False, separators=_STYLES[0])


def leaves(text: str) -> Iterator[tuple[str, str]]:
    """(path, string) of all strings that cannot be opened further. Keys with a slash or the mark are passed over: their paths would not be their own."""
    stack = [("", text, 0)]
    while stack:
        path, value, depth = stack.pop()
        if isinstance(value, str):
            inner, was = opened(value) if depth < MAX_OPENED else (value, False)
            if was:
                stack.append((path + OPENED, inner, depth + 1))
            else:
                yield path, value
        elif isinstance(value, dict):
            stack += [(f"{path}/{k}", v, depth) for k, v in reversed(value.items()) if "/" not in k and OPENED not in k]
        elif isinstance(value, list):
            stack += [(f"{path}/{k}", v, depth) for k, v in reversed(list(enumerate(value)))]


def with_texts(text: str, new: dict[str, str]) -> str:
    """The text with strings in the places of paths; a path that leads to no string is refused."""
    tree: dict = {}
    for path, value in new.items():
        at = tree
        for step in path.replace(OPENED, "/" + OPENED).split("/")[1:]:
            at = at.setdefault(step, {})
        at[None] = value
    return _put(text, tree)


def _put(value, tree: dict):
    if None in tree:
        if not isinstance(value, str) or len(tree) > 1:
            raise ValueError("no text here")
        return tree[None]
    if OPENED in tree:
        inner, was = opened(value) if isinstance(value, str) else (value, False)
        if not was or len(tree) > 1:
            raise ValueError("nothing to open here")
        return closed(_put(inner, tree[OPENED]), value)
    for step, below in tree.items():
        if isinstance(value, list):
            if not step.isdigit() or int(step) >= len(value):
                raise ValueError(f"no such place: {step}")
            value[int(step)] = _put(value[int(step)], below)
        elif isinstance(value, dict) and step in value:
            value[step] = _put(value[step], below)
        else:
            raise ValueError(f"no such place: {step}")
    return value


def nested_units(df: DataFrame, source: Column, text_col: str = "text", *keep: str) -> DataFrame:
    """keep, id, location and original_lines of the strings that read like text, under no key for programs."""
    own = exploded(df, text_col, keep, "location string, value string", leaves)
    machine = F.exists(F.split("location", f"[/{OPENED}]"), prose.machine_key)
    own = own.where(F.col("location").startswith(OPENED) & ~machine & prose.human_text(F.col("value")) & scripts.needs_translation(F.col("value"), source))
    own = own.withColumn("original_lines", F.split("value", "\n"))
    return own.withColumn("id", ids.unit_id(F.lit("nested"), F.col("location"), F.col("original_lines"))).drop("value")


def written_back(files: DataFrame, done: DataFrame, *key: str, text_col: str = "text") -> DataFrame:
    """key, text and reason of each file: with all its translations (key, location, translation), or as it was and why."""

    def one(text: str | None, edits: list | None) -> tuple[str | None, str | None]:
        try:
            return text if edits is None else with_texts(text, dict(edits)), None
        except ValueError as e:
            return text, str(e)

    edits = done.groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("location", "translation"))).alias("__edits"))
    df = files.select(*key, F.col(text_col).alias("__text")).join(edits, list(key), "left")
    out = batches.added(df, ["__text", "__edits"], {"text": ("string", pa.string()), "reason": ("string", pa.string())}, one)
    return out.select(*key, "text", "reason")
