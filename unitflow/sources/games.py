"""Event lists and databases of a game engine, as units.

A parser turns each JSON file into rows of commands and fields; messages, scrolling texts and choices are put together by Spark: a
message is the text commands after the command that opens it, a scrolling text an island of consecutive commands.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitflow.functions import ids, scripts
from unitflow.functions.written import written
from unitflow.sources.tables import exploded

# Codes of commands, files and fields of the database, the role of a text without a speaker.
OPEN, CHOICES, TEXT, SCROLL = 101, 102, 401, 405
DATABASE = ("Actors", "Armors", "Classes", "Enemies", "Items", "Skills", "States", "Weapons")
FIELDS = ("profile", "description", "message1", "message2", "message3", "message4", "name")
NARRATOR = "旁白"
#: A name that the engine fills in itself.
REFERENCE = r"^\\[Nn]\[[0-9]+\]$"


def _lists(name: str, root) -> Iterator[tuple[str, list]]:
    """(prefix, commands) of each list of commands in a file."""
    inner = root.get("events") if name.startswith("Map") and isinstance(root, dict) else root if name in ("CommonEvents.json", "Troops.json") else None
    for k, event in enumerate(inner if isinstance(inner, list) else []):
        if not isinstance(event, dict):
            continue
        number = event.get("id", k) if isinstance(event.get("id", k), int) else k
        if name == "CommonEvents.json":
            pages = [(f"{name}/{number}", event)]
        else:
            pages = [(f"{name}/{number}/{p}", page) for p, page in enumerate(event.get("pages") or []) if isinstance(page, dict)]
        yield from ((prefix, page["list"]) for prefix, page in pages if isinstance(page.get("list"), list))


def _shorts(name: str, root) -> Iterator[tuple[str, str]]:
    """(location, text) of the strings of the system file and the database."""
    if name == "System.json" and isinstance(root, dict):
        terms = root.get("terms") or {}
        yield "System.json/gameTitle", root.get("gameTitle")
        for key in ("basic", "commands", "params"):
            yield from ((f"System.json/terms/{key}/{i}", v) for i, v in enumerate(terms.get(key) or []))
        yield from ((f"System.json/terms/messages/{k}", v) for k, v in (terms.get("messages") or {}).items())
    elif name.removesuffix(".json") in DATABASE and isinstance(root, list):
        for item in root:
            if isinstance(item, dict):
                yield from ((f"{name}/{item.get('id', 0)}/{f}", item.get(f)) for f in FIELDS)


def rows_of(named: str) -> Iterator[tuple]:
    """(kind, prefix, idx, code, text, role, choices as JSON) of the commands and strings of a file; named is its name, a null character and its text."""
    name, text = named.split("\0", 1)
    root = json.loads(text)
    for prefix, commands in _lists(name, root):
        for k, command in enumerate(commands):
            command = command if isinstance(command, dict) else {}
            params = command.get("parameters") if isinstance(command.get("parameters"), list) else []
            string = lambda i, ps=params: ps[i] if len(ps) > i and isinstance(ps[i], str) else ""
            choices = [c for c in params[0] if isinstance(c, str)] if params and isinstance(params[0], list) else []
            code = command.get("code")
            yield "command", prefix, k, code if isinstance(code, int) else -1, string(0), string(4).strip(), json.dumps(choices)
    for location, value in _shorts(name, root):
        if isinstance(value, str) and value.strip():
            yield "short", location, 0, 0, value.strip(), "", "[]"


def game_units(files: DataFrame, source: Column, name_col: str = "name", text_col: str = "text", *keep: str) -> DataFrame:
    """keep, id, domain, location, context, item_type, role and original_lines of the units of a game's data files. A file that is no JSON has none."""
    named = files.select(*keep, F.concat(F.col(name_col), F.lit("\0"), F.col(text_col)).alias("__named"))
    rows = exploded(named, "__named", keep, "kind string, prefix string, idx long, code long, text string, role string, choices string", lambda x: rows_of(x) if x else iter(()))
    rows = written(rows, "game-rows")  # files are parsed once for all kinds
    commands = rows.where("kind = 'command'")
    in_list = Window.partitionBy(*keep, "prefix").orderBy("idx")
    opener = F.last(F.when(F.col("code") != TEXT, F.struct("idx", "code", "role")), ignorenulls=True).over(in_list)
    texts = commands.withColumn("opener", opener).where((F.col("code") == TEXT) & (F.col("opener.code") == OPEN))
    gathered = F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])
    messages = texts.groupBy(*keep, "prefix", F.col("opener.idx").alias("idx"), F.col("opener.role").alias("role")).agg(gathered.alias("original_lines"))
    scroll = commands.where(F.col("code") == SCROLL).withColumn("island", F.col("idx") - F.row_number().over(in_list))
    scroll = scroll.groupBy(*keep, "prefix", "island").agg(F.min("idx").alias("idx"), gathered.alias("original_lines")).withColumn("role", F.lit(""))
    choices = commands.where(F.col("code") == CHOICES).withColumn("original_lines", F.from_json("choices", "array<string>")).withColumn("role", F.lit(""))
    names = commands.where((F.col("code") == OPEN) & (F.col("role") != "") & ~F.col("role").rlike(REFERENCE))
    place = F.concat_ws("/", "prefix", F.col("idx").cast("string"))

    def unit(df: DataFrame, domain: str, item_type: str, location: Column, context: Column, role: Column, lines: Column) -> DataFrame:
        out = df.select(*keep, F.lit(domain).alias("domain"), location.alias("location"), context.alias("context"), F.lit(item_type).alias("item_type"), role.alias("role"), lines.alias("original_lines"))
        return out.where(F.exists("original_lines", lambda x: scripts.needs_translation(x, source)))

    role = F.when(F.col("role") != "", F.col("role")).otherwise(NARRATOR)
    parts = [unit(df, domain, kind, place, F.col("prefix"), role, F.col("original_lines")) for df, domain, kind in ((messages, "dialogue", "long_text"), (scroll, "scroll", "long_text"), (choices, "choices", "array"))]
    parts.append(unit(names, "namebox", "short_text", F.concat(place, F.lit("/namebox")), F.col("prefix"), F.lit("namebox"), F.array("role")))
    domain = F.when(F.col("prefix").startswith("System.json"), "system").otherwise("base")
    short = rows.where("kind = 'short'")
    parts += [unit(short.where(domain == d), d, "short_text", F.col("prefix"), F.lit(d), F.lit(NARRATOR), F.array("text")) for d in ("system", "base")]
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out.withColumn("id", ids.unit_id(F.lit("rmmz"), F.col("location"), F.col("original_lines")))
