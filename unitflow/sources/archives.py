"""Books, documents and sheets: archives of markup, as units and back again.

Archives are read as binary files where Spark finds them; each is one row, opened in the task that holds it.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.functions import ids, scripts
from unitflow.sources import markup

# Elements that hold a unit, by the kind of entry.
EBOOK = (((".xhtml", ".html", ".htm"), markup.BLOCKS - {"title"}), ((".ncx",), frozenset({"text"})), ((".opf",), frozenset({"dc:title"})))
DOCUMENT = ("word/document.xml", "word/footnotes.xml", "word/endnotes.xml")
STRINGS = "xl/sharedStrings.xml"

_RUN = re.compile(r"<(?P<name>[\w.-]+:)?t(?P<rest>\s[^>]*)?>(?P<text>[^<]*)</(?:[\w.-]+:)?t>|<(?:w:br|w:tab)\b[^>]*>", re.S)
_PHONETIC = re.compile(r"<(?:[\w.-]+:)?rPh\b.*?</(?:[\w.-]+:)?rPh>", re.S)


def _blocks_of(name: str) -> frozenset[str] | None:
    return next((tags for ends, tags in EBOOK if name.lower().endswith(ends)), None)


def _plain(text: str) -> str:
    return markup._ENTITY.sub(markup._decoded, text)


def _outside(text: str, spans: list[tuple[int, int]]) -> Iterator[re.Match]:
    """Runs of text that lie in none of the spans."""
    for m in _RUN.finditer(text):
        if not any(a <= m.start() < b for a, b in spans):
            yield m


def _runs(inside: str) -> str:
    """The text of the runs inside an element; breaks and tabs are spaces, readings are left out."""
    spans = [m.span() for m in _PHONETIC.finditer(inside)]
    return "".join(" " if m["text"] is None else _plain(m["text"]) for m in _outside(inside, spans))


def elements(kind: str, name: str, body: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of what holds a unit in an entry: innermost blocks, paragraphs or shared strings."""
    if kind == "epub":
        return markup.leaf_spans(body, _blocks_of(name))
    tags = frozenset({"w:p"}) if kind == "docx" else frozenset({"si"})
    plain = re.sub(r"(</?)[\w.-]+:si\b", r"\1si", body) if kind == "xlsx" else body  # same names, whatever their prefix
    found = markup.leaf_spans(plain, tags) if plain == body else []
    if plain != body:
        found = [(m.start(1), m.end(1), "") for m in re.finditer(r"<[\w.-]+:si\b[^>/]*>(.*?)</[\w.-]+:si>", body, re.S)]
    return [(a, b, _runs(body[a:b])) for a, b, _ in found]


def _entries(kind: str, archive: zipfile.ZipFile) -> list[str]:
    names = archive.namelist()
    if kind == "epub":
        return [n for n in names if _blocks_of(n) is not None]
    return [n for n in (DOCUMENT if kind == "docx" else (STRINGS,)) if n in names]


def location(kind: str, name: str, k: int) -> str:
    return f"si{k:06d}" if kind == "xlsx" else f"{name}#b{k:05d}"


def rows_of(kind: str, content: bytes) -> Iterator[tuple[str, str, str]]:
    """(location, scene, text) of each element of an archive."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in _entries(kind, archive):
            for k, (_, _, text) in enumerate(elements(kind, name, archive.read(name).decode("utf-8"))):
                yield location(kind, name, k), {"epub": name, "docx": f"{name}/s{k // 30:04d}", "xlsx": f"s{k // 40:04d}"}[kind], text


def archive_units(files: DataFrame, source: Column, kind: str, content_col: str = "content", *keep: str) -> DataFrame:
    """keep, id, location, context and original_lines of each element of epub, docx or xlsx archives in the source language. What is no such archive has none."""
    if kind not in ("epub", "docx", "xlsx"):
        raise ValueError(f"unknown archive {kind!r}")
    df = files.select(*keep, F.col(content_col).alias("__content"))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(len(keep))[i].as_py()
                try:
                    rows = list(rows_of(kind, content or b""))
                except (zipfile.BadZipFile, ValueError):
                    continue
                at = pa.array([i] * len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keep))), *(pa.array([r[k] for r in rows], pa.string()) for k in range(3))], names=[*keep, "location", "context", "text"])

    out = df.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "location string, context string, text string"]))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: scripts.trim(x)), lambda x: x != "") if kind == "epub" else F.array("text") if kind == "docx" else F.split("text", "\n")
    out = out.withColumn("original_lines", lines).where(F.exists("original_lines", lambda x: scripts.needs_translation(x, source)))
    return out.withColumn("id", ids.unit_id(F.lit(kind), F.col("location"), F.col("original_lines"))).drop("text")


def _rewritten(kind: str, name: str, body: str, new: dict[int, list[str]], glue: str) -> str:
    if kind == "epub":
        return markup.rewritten(body, new, _blocks_of(name))
    out, at = [], 0
    for k, (start, stop, _) in enumerate(elements(kind, name, body)):
        if k not in new:
            continue
        inside, text = body[start:stop], markup.escaped(glue.join(new[k]))
        spans, first, put, to = [m.span() for m in _PHONETIC.finditer(inside)], True, [], 0
        for m in _outside(inside, spans):
            if m["text"] is None:
                continue
            keep = m["rest"] or ""
            if first and "xml:space" not in keep:
                keep += ' xml:space="preserve"'
            tag = f"{m['name'] or ''}t"
            put += [inside[to : m.start()], f"<{tag}{keep}>{text if first else ''}</{tag}>"]
            first, to = False, m.end()
        out += [body[at:start], "".join(put) + inside[to:]]
        at = stop
    return "".join(out) + body[at:]


def archive_bytes(kind: str, content: bytes, new: dict[str, list[str]], target: str) -> bytes:
    """An archive with the texts at locations replaced: all of a paragraph's text goes to its first run, other entries are copied as they are, in their
    order and with their compression; a book also names its new language."""
    glue = "\n" if kind == "xlsx" else "" if target.split("-")[0] in ("zh", "ja") else " "
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as archive, zipfile.ZipFile(out, "w") as written:
        texts = set(_entries(kind, archive))
        for info in archive.infolist():
            data = archive.read(info)
            if info.filename in texts:
                body = data.decode("utf-8")
                own = {k: new[x] for k in range(len(elements(kind, info.filename, body))) if (x := location(kind, info.filename, k)) in new}
                body = _rewritten(kind, info.filename, body, own, glue) if own else body
                if kind == "epub" and info.filename.lower().endswith(".opf"):
                    body = re.sub(r"(<dc:language\b[^>]*>)[^<]*", lambda m: m[1] + target, body)
                data = body.encode()
            written.writestr(info, data, compress_type=info.compress_type)
    return out.getvalue()


def render_archives(files: DataFrame, translated: DataFrame, key: list[str], kind: str, target: str, content_col: str = "content") -> DataFrame:
    """key and content of each archive with its translations. translated: key, location and translation_lines."""
    own = translated.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("location", "translation_lines"))).alias("__new"))
    df = files.select(*key, F.col(content_col).alias("__content")).join(own, key, "left")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(len(key)).to_pylist(), batch.column(len(key) + 1).to_pylist(), strict=True)
            out = [c if c is None else archive_bytes(kind, c, dict(n or []), target) for c, n in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(key))), pa.array(out, pa.binary())], names=[*key, "content"])

    return df.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in key), "content binary"]))
