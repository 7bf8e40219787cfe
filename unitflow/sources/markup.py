"""HTML pages as units: one for each innermost block of text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.functions import ids, scripts
from unitflow.functions.batches import pieces

# Elements that may hold a block of text, elements whose text is no prose, elements without an end tag.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd th td caption figcaption blockquote div title".split())
SKIPPED = frozenset("rt rp script style".split())
VOID = frozenset("br img hr meta link input wbr source col area base embed track".split())
# Entities that are decoded besides numeric ones.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}

_PIECE = re.compile(r"(?P<misc><!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!.*?>)|</\s*(?P<close>[^\s/>]*)(?:\"[^\"]*\"|'[^']*'|[^>])*>|<\s*(?P<open>[^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>])*)>|(?P<text>[^<]+)", re.S)
_ENTITY = re.compile(r"&([^;&]{1,11});")


def _decoded(m: re.Match) -> str:
    name = m[1]
    if name in ENTITIES:
        return ENTITIES[name]
    try:
        code = int(name[2:], 16) if name[:2] in ("#x", "#X") else int(name[1:]) if name[:1] == "#" else -1
        return chr(code) if code >= 0 and not 0xD800 <= code < 0xE000 else m[0]
    except (ValueError, OverflowError):
        return m[0]


class _Open:
    """An element that is not closed yet."""

    __slots__ = ("name", "is_block", "has_block", "skipped", "start", "inner", "text")

    def __init__(self, name: str, start: int, inner: int, blocks: frozenset[str]):
        self.name, self.start, self.inner, self.text = name, start, inner, []
        low = name.lower()
        self.is_block, self.skipped, self.has_block = low in blocks, low in SKIPPED, False


def leaf_blocks(html: str) -> list[str]:
    """Texts of the blocks that hold no other block, in the order in which they begin."""
    return [text for _, _, text in leaf_spans(html)]


def leaf_spans(html: str, blocks: frozenset[str] = BLOCKS) -> list[tuple[int, int, str]]:
    """(start and end of what stands inside, text) of the blocks that hold no other block, in the order in which they begin.

    An end tag closes the nearest open element of its name with all that opened inside it; one without such an element is
    passed over. Elements never closed end with the page. Line breaks become line feeds.
    """
    stack: list[_Open] = []
    found: list[tuple[int, int, int, str]] = []

    def close(stop: int) -> None:
        e = stack.pop()
        if e.is_block and not e.has_block:
            found.append((e.start, e.inner, stop, "".join(e.text)))
        if stack:
            above = stack[-1]
            above.has_block |= e.is_block or e.has_block
            if not e.skipped:
                above.text += e.text

    at = 0
    while (m := _PIECE.match(html, at)) is not None:
        at = m.end()
        if m["text"] is not None:
            if stack:
                stack[-1].text.append(_ENTITY.sub(_decoded, m["text"]))
        elif m["close"] is not None:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].name == m["close"]), None)
            while depth is not None and len(stack) > depth:
                close(m.start())
        elif m["open"] is not None:
            if m["rest"].endswith("/") or m["open"].lower() in VOID:
                if m["open"].lower() == "br" and stack:
                    stack[-1].text.append("\n")
            else:
                stack.append(_Open(m["open"], m.start(), m.end(), blocks))
    if at < len(html):
        raise ValueError(f"unclosed tag at character {at}")
    while stack:
        close(len(html))
    return [(inner, stop, text) for _, inner, stop, text in sorted(found)]


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def rewritten(html: str, new: dict[int, list[str]], blocks: frozenset[str] = BLOCKS) -> str:
    """A page with the insides of innermost blocks replaced, by their number: lines with breaks between them. All else stays as it is."""
    out, at = [], 0
    for k, (start, stop, _) in enumerate(leaf_spans(html, blocks)):
        if k in new:
            out += [html[at:start], "<br/>".join(map(escaped, new[k]))]
            at = stop
    return "".join(out) + html[at:]


def html_text(html: str, new: dict[str, list[str]]) -> str:
    """rewritten() by location: #b00000."""
    return rewritten(html, {int(k.rsplit("#b", 1)[1]): v for k, v in new.items()})


def html_units(pages: DataFrame, source: Column, text_col: str = "html", *keep: str) -> DataFrame:
    """keep, index (counting all innermost blocks), location, context, original_lines and identity of each block in the source language.

    A page that ends inside a tag gives no units. Narrow: pages are parsed where they lie.
    """
    own = pages.select(*keep, F.col(text_col).alias("__html"))
    types = {f.name: f.dataType for f in own.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            rows, numbers, texts = [], [], []
            for k, html in enumerate(batch.column(len(keep)).to_pylist()):
                try:
                    blocks = leaf_blocks(html or "")
                except ValueError:
                    continue
                rows += [k] * len(blocks)
                numbers += range(len(blocks))
                texts += blocks
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows, pa.int64())) for i in range(len(keep))), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], names=[*keep, "index", "text"])

    schema = ", ".join([*(f"`{k}` {types[k].simpleString()}" for k in keep), "index long, text string"])
    df = own.mapInArrow(run, schema).withColumn("text", scripts.trim(F.col("text"))).where(scripts.needs_translation(F.col("text"), source))
    lines = F.transform(F.split("text", "\n"), lambda x: scripts.trim(x))
    df = df.withColumn("location", F.format_string("#b%05d", "index")).withColumn("context", F.format_string("s%04d", F.floor(F.col("index") / 30))).withColumn("original_lines", lines)
    return df.withColumn("id", ids.unit_id(F.lit("html"), F.col("location"), F.col("original_lines")))
