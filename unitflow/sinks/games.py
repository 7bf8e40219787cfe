"""Writes a game's data files: translations go into the slots their units came from; no command is ever inserted, moved or taken out.

What may not change in a file is its anchor: a hash over the tree of events, pages, conditions, commands, codes and parameters, in
which each text that is translated counts by its shape alone (a string, a list of so many strings). A file whose anchor is not the one that was stored when
its units were read is refused as a whole, and so is one with a slot that is not there; other files are written.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.functions import batches
from unitflow.operators import fitting
from unitflow.sources.games import CHOICES, DATABASE, FIELDS, OPEN, SCROLL, TEXT

_EDITS = "array<struct<location:string,domain:string,lines:array<string>>>"


def _shape(value):
    """A value with strings as marks."""
    if isinstance(value, str):
        return "\0text"
    if isinstance(value, list):
        return [_shape(x) for x in value]
    return {k: _shape(v) for k, v in value.items()} if isinstance(value, dict) else value


def _masked(command):
    if not isinstance(command, dict) or not isinstance(command.get("parameters"), list):
        return command
    at = {TEXT: 0, SCROLL: 0, CHOICES: 0, OPEN: 4}.get(command.get("code"))
    return command | {"parameters": [_shape(p) if k == at else p for k, p in enumerate(command["parameters"])]}


def _listed(value, mask):
    return [mask(x) for x in value] if isinstance(value, list) else value


def _page(page):
    return {"conditions": page.get("conditions"), "list": _listed(page.get("list"), _masked)} if isinstance(page, dict) else page


def structure(name: str, root):
    """What an anchor is the hash of: what stays of a file, texts as marks."""
    if name == "System.json":
        return [_shape(root.get("gameTitle")), _shape(root.get("terms"))] if isinstance(root, dict) else root
    if name.removesuffix(".json") in DATABASE:
        return _listed(root, lambda x: {"id": x.get("id"), **{f: _shape(x.get(f)) for f in FIELDS}} if isinstance(x, dict) else x)
    inner = root.get("events") if name.startswith("Map") and isinstance(root, dict) else root
    one = (lambda x: {"list": _listed(x.get("list"), _masked)}) if name == "CommonEvents.json" else (lambda x: {"pages": _listed(x.get("pages"), _page)})
    return _listed(inner, lambda x: {"id": x.get("id"), "name": x.get("name"), **one(x)} if isinstance(x, dict) else x)


def anchor(name: str, text: str | None) -> str | None:
    """The anchor of a file; none for what is no JSON."""
    try:
        root = json.loads(text or "")
    except (ValueError, RecursionError):
        return None
    return hashlib.sha256(json.dumps(structure(name, root), ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")).hexdigest()


def anchors(files: DataFrame, *keep: str, name_col: str = "name", text_col: str = "text") -> DataFrame:
    """keep, name and anchor of each file."""

    own = files.select(*keep, F.col(name_col).alias("name"), F.col(text_col).alias("__text"))
    return _anchored(own, "__text", "anchor").drop("__text")


def _anchored(files: DataFrame, text_col: str, column: str) -> DataFrame:
    return batches.added(files, ["name", text_col], {column: ("string", pa.string())}, lambda name, text: (anchor(name, text),))


class _Refused(ValueError):
    pass


def _find(values, number: int):
    """The entry of an id, or of a place where entries have none."""
    for k, x in enumerate(values if isinstance(values, list) else []):
        if isinstance(x, dict) and (x["id"] if isinstance(x.get("id"), int) else k) == number:
            return x
    raise _Refused("no such entry")


def _commands(name: str, root, parts: list[str]) -> tuple[list, int]:
    """The list of commands of a location, and the place in it."""
    inner = root.get("events") if name.startswith("Map") else root
    entry = _find(inner, int(parts[0]))
    if name == "CommonEvents.json":
        commands, at = entry.get("list"), parts[1]
    else:
        pages = entry.get("pages") or []
        commands, at = pages[int(parts[1])].get("list"), parts[2]
    if not isinstance(commands, list) or int(at) >= len(commands) or not isinstance(commands[int(at)], dict):
        raise _Refused("no such command")
    return commands, int(at)


def _slot(command: dict, code: int, place: int, kind) -> list:
    """The parameters of a command of this code that has such a value in that place."""
    params = command.get("parameters")
    if command.get("code") != code or not isinstance(params, list) or len(params) <= place or not isinstance(params[place], kind):
        raise _Refused("another command")
    return params


def _write_one(name: str, root, location: str, domain: str, lines: list[str], rules: tuple[fitting.Rule, ...]) -> None:
    parts = location.split("/")[1:]
    if domain in ("system", "base"):
        if domain == "base":
            holder = _find(root, int(parts[0]))
        else:
            holder = root
            for p in parts[:-1]:
                holder = holder[int(p)] if isinstance(holder, list) else holder[p]
        key = int(parts[-1]) if isinstance(holder, list) else parts[-1]
        if not isinstance(holder[key], str):
            raise _Refused("no text here")
        holder[key] = lines[0] if lines else ""
        return
    commands, at = _commands(name, root, parts)
    if domain == "namebox":
        _slot(commands[at], OPEN, 4, str)[4] = lines[0] if lines else ""
    elif domain == "choices":
        params = _slot(commands[at], CHOICES, 0, list)
        if len(params[0]) != len(lines) or not all(isinstance(x, str) for x in params[0]):
            raise _Refused("another number of choices")
        params[0] = list(lines)
    else:
        code, first = (TEXT, at + 1) if domain == "dialogue" else (SCROLL, at)
        stop = first
        while stop < len(commands) and isinstance(commands[stop], dict) and commands[stop].get("code") == code:
            stop += 1
        slots = [_slot(c, code, 0, str) for c in commands[first:stop]]
        if not slots:
            raise _Refused("no slots")
        original = [s[0] for s in slots]
        fitted, _ = fitting.fit_one(domain, original, list(lines), len(slots), rules or (fitting.Rule(),))
        for s, line in zip(slots, fitted + [""] * (len(slots) - len(fitted)), strict=True):
            s[0] = line


def write_file(name: str, text: str, edits, rules: tuple[fitting.Rule, ...] = ()) -> tuple[str, str | None]:
    """A file with all its edits (location, domain, lines) and no reason, or as it was and why."""
    try:
        root = json.loads(text)
        before = structure(name, root)
        before = json.dumps(before)
        for e in edits:
            _write_one(name, root, e["location"], e["domain"], list(e["lines"]), rules)
    except _Refused as e:
        return text, str(e)
    except (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError):
        return text, "no such place"
    if json.dumps(structure(name, root)) != before:
        return text, "the structure would change"
    return json.dumps(root, ensure_ascii=False, separators=(",", ":")), None


def game_files(files: DataFrame, done: DataFrame, stored: DataFrame, rules: list[fitting.Rule] | None = None, keep: tuple[str, ...] = (), name_col: str = "name", text_col: str = "text") -> DataFrame:
    """keep, name, text and reason of each file: with its translations, or as it was and why. done: keep, location, domain and lines; stored: what anchors() gave
    when the units were read. Files without translations stay, byte for byte, but are refused like others where their anchor is not the stored one.
    """
    rules_ = fitting.ordered(rules or [])
    key = [*keep, "name"]

    def one(name: str, text: str, edits: list | None) -> tuple[str, str | None]:
        return (None, None) if edits is None else write_file(name, text, edits, rules_)

    own = _anchored(files.select(*keep, F.col(name_col).alias("name"), F.col(text_col).alias("text")), "text", "now")
    edits = done.select(*keep, F.substring_index("location", "/", 1).alias("name"), F.struct("location", "domain", "lines").alias("edit"))
    edits = edits.groupBy(*key).agg(F.sort_array(F.collect_list("edit")).cast(_EDITS).alias("edits"))
    joined = own.join(stored.select(*key, "anchor"), key, "left").join(edits, key, "left")
    why = F.when(F.col("anchor").isNull(), "no anchor is stored").when(~F.col("now").eqNullSafe(F.col("anchor")), "the structure has changed")
    joined = joined.withColumn("why", why).withColumn("edits", F.when(F.col("why").isNull(), F.col("edits"))).drop("now", "anchor")
    made = batches.added(joined, ["name", "text", "edits"], {"made": ("string", pa.string()), "reason": ("string", pa.string())}, one)
    return made.select(*key, F.coalesce("made", "text").alias("text"), F.coalesce("why", "reason").alias("reason"))
