"""Renderers: source texts with translations in the places of their units.

Lines are joined with translations by position and put together again by Spark, so a file is gathered only as one row of its own text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.functions import batches
from unitflow.sources.lines import lines as source_lines
from unitflow.sources.tables import csv_spans, po_entries


def output_name(name: Column, language: Column) -> Column:
    """stem.language.extension, in the folder of the source."""
    extension = F.regexp_extract(name, r"\.([^./]+)$", 1)
    stem = F.when(extension != "", F.left(name, F.char_length(name) - F.char_length(extension) - 1)).otherwise(name)
    return F.when(extension != "", F.concat_ws(".", stem, language, extension)).otherwise(F.concat_ws(".", stem, language))


def lines(files: DataFrame, translated: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """key and text of each file with translated lines. translated: key, pos (from 1), prefix (kept before the text) and target.

    Carriage returns and the file's last line feed stay. Only the translated lines are grouped by file; untouched files need no group.
    """
    own = translated.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("pos", F.concat("prefix", "target").alias("line")))).alias("new"))
    df = files.join(own, key, "left")
    parts = F.split(F.col(text_col), "\n")
    put = F.transform(parts, lambda x, i: F.coalesce(F.concat(F.try_element_at("new", (i + 1).cast("long")), F.when(x.endswith("\r"), "\r").otherwise("")), x))
    return df.select(*key, F.when(F.col("new").isNull(), F.col(text_col)).otherwise(F.array_join(put, "\n")).alias("text"))


def replaced(files: DataFrame, edits: DataFrame, key: list[str], text_col: str = "text", end: str | None = None) -> DataFrame:
    """key and text of each file with whole lines replaced. edits: key, pos (from 1) and line, null for a line that goes. Line ends stay as the
    file's first one is; with end, the file ends with one."""
    own = edits.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("line").alias("new")))).alias("new"))
    df = files.join(own, key, "left")
    text = F.col(text_col)
    sep = F.when(F.contains(text, F.lit("\r\n")), "\r\n").otherwise("\n")
    parts = F.transform(F.split(F.regexp_replace(text, r"\r?\n\z", ""), "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    put = F.filter(F.transform(parts, lambda x, i: F.when(F.try_element_at("new", (i + 1).cast("long")).isNotNull(), F.try_element_at("new", (i + 1).cast("long"))["line"]).otherwise(x)), lambda x: x.isNotNull())
    tail = F.when(F.lit(end is not None) | text.rlike(r"\n\z"), sep).otherwise("")
    return df.select(*key, F.when(text.isNotNull(), F.concat(F.call_function("array_join", put, sep), tail)).alias("text"))


def _lines_of(files: DataFrame, translated: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """translated with the line it stands in, as line."""
    own = source_lines(files, text_col, *key)
    return translated.join(own, [*key, "pos"])


def lrc(files: DataFrame, translated: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """Lyrics: the time tags stay, lines are joined by spaces. translated: key, pos and translation_lines."""
    tags = F.regexp_extract("line", r"^(?:\[[0-9][^\]]*+\])++", 0)
    edits = _lines_of(files, translated, key, text_col).select(*key, "pos", F.concat(tags, F.array_join("translation_lines", " ")).alias("line"))
    return replaced(files, edits, key, text_col, "\n")


def ass(files: DataFrame, translated: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """Subtitle scripts: what stands before the text stays, lines are joined by the script's own break. translated: key, pos, original_lines and translation_lines."""
    whole = F.regexp_replace("line", r"(?U)\s+\z", "")
    before = F.left(whole, F.char_length(whole) - F.char_length(F.col("original_lines")[0]))
    edits = _lines_of(files, translated, key, text_col).select(*key, "pos", F.concat(before, F.array_join("translation_lines", "\\N")).alias("line"))
    return replaced(files, edits, key, text_col)


def _escaped(text: Column, *more: tuple[str, str]) -> Column:
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), *more):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def renpy(files: DataFrame, translated: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """Game scripts: the last quoted string of a line is replaced. translated: key, pos and translation_lines."""
    quoted = r'"(?:[^"\\]++|\\.)*+"'
    last, rest = F.element_at(F.regexp_extract_all("line", F.lit(quoted), F.lit(0)), -1), F.element_at(F.split("line", quoted), -1)
    before = F.left("line", F.char_length("line") - F.char_length(rest) - F.char_length(last))
    text = F.concat(before, F.lit('"'), _escaped(F.array_join("translation_lines", "\n")), F.lit('"'), rest)
    edits = _lines_of(files, translated, key, text_col).where(F.col("line").rlike(quoted)).select(*key, "pos", text.alias("line"))
    return replaced(files, edits, key, text_col, "\n")


def cues(files: DataFrame, translated: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """Subtitles: what stands after a cue's timing line is replaced; one blank line between blocks. translated: key, pos (the block, from 0) and translation_lines."""
    own = translated.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("int"), "translation_lines"))).alias("new"))
    text = F.col(text_col)
    sep = F.when(F.contains(text, F.lit("\r\n")), "\r\n").otherwise("\n")
    plain = F.regexp_replace(text, r"(?U)\A\s*\n|\s+\z", "")
    blocks = F.transform(F.split(F.regexp_replace(plain, "\r\n", "\n"), r"(?U)\n(?:[\s&&[^\n]]*+\n)++"), lambda b: F.split(b, "\n"))

    def put(block: Column, i: Column) -> Column:
        timing = F.array_position(F.transform(block, lambda x: F.contains(x, F.lit("-->"))), True).cast("int")
        new = F.try_element_at("new", i)
        return F.when(new.isNotNull() & (timing > 0), F.concat(F.slice(block, F.lit(1), timing), new)).otherwise(block)

    df = files.join(own, key, "left")
    joined = F.call_function("array_join", F.transform(F.transform(blocks, lambda b, i: put(b, i)), lambda b: F.call_function("array_join", b, sep)), F.concat(sep, sep))
    return df.select(*key, F.when(text.isNotNull(), F.concat(joined, sep)).alias("text"))


def rendered(files: DataFrame, translated: DataFrame, key: list[str], render: Callable[[str, dict], str], text_col: str = "text", untouched: bool = True) -> DataFrame:
    """key and text of each file, put together by a function of the file's text and {location: lines}. translated: key, location and translation_lines.
    Files without translations stay as they are or, not untouched, are written like the others; a file is one row, whatever the number of its units."""
    own = translated.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("location", "translation_lines"))).alias("__new"))
    df = files.select(*key, F.col(text_col).alias("__text")).join(own, key, "left")

    def one(text: str | None, new: list | None) -> tuple[str | None]:
        return (text if text is None or untouched and not new else render(text, dict(new or ())),)

    return batches.added(df, ["__text", "__new"], {"text": ("string", pa.string())}, one).select(*key, "text")


def po_text(text: str, new: dict[str, list[str]]) -> str:
    """A catalogue with the translations of entries e00000, e00001 ... in one line each, which ends with a line feed if the source does."""
    escape = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t"}
    blocks = [b.split("\n") for b in re.split(r"\n(?:[^\S\n]*\n)+", text.replace("\r\n", "\n").strip("\n")) if b.strip()]
    for k, block in enumerate(blocks):
        lines = new.get(f"e{k:05d}")
        starts = [i for i, x in enumerate(block) if x.strip().startswith("msgstr")]
        if lines is None or not starts:
            continue
        stop = next((i for i in range(starts[0] + 1, len(block)) if not block[i].strip().startswith('"')), len(block))
        source = [x for _, x in po_entries("\n".join(block))]
        value = "\n".join(lines) + ("\n" if source and source[0].endswith("\n") and not (lines and lines[-1] == "") else "")
        block[starts[0] : stop] = ['msgstr "' + "".join(escape.get(c, c) for c in value) + '"']
    return "\n\n".join("\n".join(b) for b in blocks) + "\n"


def csv_text(text: str, cells: dict[tuple[int, int], str], delimiter: str = ",") -> str:
    """A table with cells replaced. Records without such cells stay as they are; the others are written with quotes where they must be."""
    quoted = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in (delimiter, '"', "\n", "\r")) else s
    touched, out, at = {r for r, _ in cells}, [], 0
    for r, (start, stop, fields) in enumerate(csv_spans(text, delimiter)):
        if r in touched:
            out += [text[at:start], delimiter.join(quoted(cells.get((r, c), v)) for c, v in enumerate(fields))]
            at = stop
    return "".join(out) + text[at:]


def csv_cells(text: str, new: dict[str, list[str]], delimiter: str = ",") -> str:
    """csv_text() by location: r000000/0."""
    return csv_text(text, {(int(k[1:7]), int(k.split("/")[1])): "\n".join(v) for k, v in new.items()}, delimiter)


def set_path(root, path: str, value):
    """Puts a value in the place of the string at a path of keys and places of a JSON tree; a path that leads to none is refused."""
    *above, last = path.split("/")
    try:
        for name in above:
            root = root[int(name)] if isinstance(root, list) else root[name]
        last = int(last) if isinstance(root, list) else last
        found = root[last]
    except (KeyError, IndexError, ValueError, TypeError) as e:
        raise ValueError(f"no such path: {path}") from e
    if not isinstance(found, str):
        raise ValueError(f"no text at {path}")
    root[last] = value


def json_text(kind: str, text: str, new: dict[str, list[str]]) -> str:
    """A JSON file of one of the shapes with its translations, indented by two. A translation of a path that is not there fails the write."""
    root = json.loads(text)
    values = {k: "\n".join(v) for k, v in new.items()}
    if kind == "mtool":
        root = {k: values.get(f"k{i:06d}", v) for i, (k, v) in enumerate(root.items())}
    elif kind in ("paratranz", "vnt"):
        letter, field = ("p", "translation") if kind == "paratranz" else ("m", "message")
        for i, record in enumerate(root):
            if (value := values.get(f"{letter}{i:06d}")) is not None:
                record[field] = value
    else:
        for path, value in values.items():
            set_path(root, path, value)
    return json.dumps(root, indent=2, ensure_ascii=False) + "\n"


def jsonl(units: DataFrame, *more: str) -> DataFrame:
    """A line of JSON for each unit: id (its location), text, context, role and item_type where it has them, and its translation, if any. units: location,
    original_lines and translation_lines."""
    here = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    named = [here(c) for c in ("context", "role", "item_type") if c in units.columns]
    record = F.struct(F.col("location").alias("id"), F.array_join("original_lines", "\n").alias("text"), *named, "translation_lines")
    return units.select(*more, F.to_json(record).alias("value"))
