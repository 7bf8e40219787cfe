"""Files of no declared format: what reads like text is found as spans of bytes, and translations are put in their places.

A file is JSON, XML, settings (INI, TOML or a flat YAML) or prose, by the first scanner that takes the whole of it; tables of delimited rows and all else
have no spans. Scanners run in Arrow batches and give each string with its bytes, its style (how it is written) and its path; which of them are for people is
told by Spark expressions. A span's anchor is its file, the hash of the file, its bytes and its style.

Writing gathers edits by file and joins them with the files as they are: a file is scanned where its row lies, and an anchor that no longer meets its own span
is refused. Edits of a file that do not overlap are woven into its bytes, the new file is scanned again, and its spans must be the old ones with the new
texts; else the file stays as it was. Bytes outside the edits never change. No span is shuffled, but those that are edited.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import tomllib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.functions import batches, ids, prose, scripts
from unitflow.sources.tables import exploded

MAX_DEPTH = 128
JSON, XML, DOUBLE, SINGLE, SINGLE_YAML, BARE_YAML, BARE_INI, PROSE = "json", "xml", "double", "single", "single_yaml", "bare_yaml", "bare_ini", "prose"
#: What a line of prose does not hold, and how lines of programs begin.
NO_PROSE = "=<>;[]#*|$()"
CODE = (
    "fn ", "function ", "def ", "class ", "import ", "from ", "use ", "return ", "let ", "const ", "var ", "if ", "else", "while ", "for ", "print(", "console.", "//", "/*", "--", "#!",
    "echo ", "printf ", "select ", "insert ", "update ", "delete ", "write-host ", "export ", "set ", "call ", "rem ",
)
Span = tuple[int, int, str, str, str]

_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"|[{}\[\],:]', re.S)


def json_spans(data: bytes) -> list[Span] | None:
    """Strings that are values, at paths of keys and places; None for what is no JSON object or list, or nested too deep."""
    if data.lstrip()[:1] not in (b"{", b"["):
        return None
    try:
        json.loads(data, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    out: list[Span] = []
    stack: list[list] = []  # of each open container: whether it is an object, its key or place, whether a key comes next
    for m in _TOKEN.finditer(data):
        token = m[0]
        if token in (b"{", b"["):
            stack.append([token == b"{", "" if token == b"{" else 0, token == b"{"])
            if len(stack) > MAX_DEPTH:
                return None
        elif token in (b"}", b"]"):
            stack.pop()
        elif token == b":":
            stack[-1][2] = False
        elif token == b",":
            if stack[-1][0]:
                stack[-1][2] = True
            else:
                stack[-1][1] += 1
        elif stack[-1][2]:
            stack[-1][1] = _plain(token)
        else:
            out.append((m.start(), m.end(), JSON, "/".join([str(s[1]) for s in stack]), _plain(token)))
    return out


def _plain(token: bytes) -> str:
    """What a string of JSON holds."""
    return json.loads(token) if b"\\" in token else token[1:-1].decode()


def _refuse(name: str):
    raise ValueError(name)


_MARKUP = re.compile(rb"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|<!DOCTYPE[^>\[]*>|<(/?)([^\s/>]+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*?)(/?)>", re.S)


def xml_spans(data: bytes) -> list[Span] | None:
    """Texts between tags, without the blanks around them, at paths of tags; None for what an XML parser refuses."""
    from xml.parsers import expat

    if data.lstrip()[:1] != b"<":
        return None
    try:
        parser = expat.ParserCreate()
        parser.EntityDeclHandler = lambda *_: _refuse("entities are not read")
        parser.Parse(data, True)
    except (expat.ExpatError, ValueError):
        return None
    out, stack, at = [], [], 0
    for m in _MARKUP.finditer(data):
        out += _trimmed(data, at, m.start(), XML, "/".join(stack))
        at = m.end()
        if m[2] is not None:
            if m[1]:
                stack.pop()
            elif not m[4]:
                stack.append(m[2].decode())
                if len(stack) > MAX_DEPTH:
                    return None
    return out


def _trimmed(data: bytes, start: int, end: int, style: str, path: str) -> Iterator[Span]:
    raw = data[start:end].decode()
    text = raw.strip()
    if text:
        low = start + len(raw[: len(raw) - len(raw.lstrip())].encode())
        yield low, low + len(text.encode()), style, path, unescape(text) if style == XML else text


_PAIR = re.compile(r"^([ \t]*)([\w.-]+)([ \t]*)([=:])(.*)$")
_QUOTED = re.compile(r"""("(?:[^"\\]|\\.)*"|'[^']*(?:''[^']*)*')(.*)$""")


def setting_spans(data: bytes, hint: str | None = None) -> tuple[str, list[Span]] | None:
    """The dialect and the values of settings, at paths of sections or parents and keys; None unless every line is a comment, a section or a pair, all
    pairs by one sign. hint: ini, toml or yaml, where a file's name tells; without, pairs by = need a section or a comment of INI beside them."""
    text = data.decode()
    rows = [(line, line.strip()) for line in text.split("\n")]
    signs, listed = set(), []
    for line, bare in rows:
        skipped = not bare or bare[0] in "#;" or bare in ("---", "...")
        m = None if skipped or bare[0] == "[" else _PAIR.match(line.rstrip("\r"))
        if not skipped and bare[0] != "[":
            if not m or m[4] == ":" and m[5] and not m[5][0].isspace():
                return None
            signs.add(m[4])
        listed.append((line, bare, skipped, m))
    if len(signs) != 1:
        return None
    if signs == {":"}:
        dialect = "yaml"
    else:
        if hint is None and not any(bare[:1] in ("[", ";") for _, bare in rows):
            return None
        dialect = "ini" if hint == "ini" or not _is_toml(text) else "toml"
    if hint and hint != dialect:
        return None
    out, at, section, parents = [], 0, "", []
    for line, bare, skipped, m in listed:
        size = len(line.encode()) + 1
        if not skipped and bare[0] == "[":
            if dialect == "yaml" or "]" not in bare or bare[bare.index("]") + 1 :].strip()[:1] not in ("", "#", ";"):
                return None
            section = bare[1 : bare.index("]")].strip()
        elif m and not skipped:
            if dialect == "yaml":
                if "\t" in m[1]:
                    return None
                while parents and parents[-1][0] >= len(m[1]):
                    parents.pop()
            value = m[5].strip()
            path = "/".join([section] * bool(section) + [p for _, p in parents] + [m[2]])
            if dialect == "yaml" and (not value or value[0] == "#"):
                parents.append((len(m[1]), m[2]))
            else:
                found = _value(value, dialect)
                if found is None:
                    return None
                n, style, own = found
                start = at + len(line[: m.start(5) + len(m[5]) - len(m[5].lstrip())].encode())
                if own is not None:
                    out.append((start, start + len(value[:n].encode()), style, path, own))
        at += size
    return dialect, out


def _is_toml(text: str) -> bool:
    try:
        tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return False
    return True


def _value(value: str, dialect: str) -> tuple[int, str, str | None] | None:
    """Length, style and text of a value before a comment; no text for what is typed, None for what is not read."""
    if value[:1] in ('"', "'"):
        if value.startswith(('"""', "'''")):
            return None
        m = re.match(r"('[^']*')(.*)$", value) if value[0] == "'" and dialect != "yaml" else _QUOTED.match(value)
        if not m or m[2].strip()[:1] not in ("", "#", *(";" * (dialect == "ini"))):
            return None
        try:
            text = tomllib.loads(f"v = {m[1]}")["v"] if dialect == "toml" else json.loads(m[1]) if value[0] == '"' else m[1][1:-1]
        except ValueError:
            return None
        if value[0] == '"':
            return len(m[1]), DOUBLE, text
        return len(m[1]), *((SINGLE_YAML, text.replace("''", "'")) if dialect == "yaml" else (SINGLE, text))
    sign = re.search(r"[#;]" if dialect == "ini" else r"(?:^|(?<=\s))#", value)
    text = value[: sign.start()].rstrip() if sign else value
    if dialect == "toml":
        return len(text), BARE_INI, None
    if dialect == "yaml" and (text[:1] in tuple("[{|>&*!@`") or ": " in text):
        return None
    return len(text), BARE_YAML if dialect == "yaml" else BARE_INI, text


def prose_spans(data: bytes) -> list[Span] | None:
    """Lines of prose, trimmed; None unless every line with text surely is prose."""
    out, at = [], 0
    for line in data.split(b"\n"):
        text = line.decode().strip()
        if text:
            if any(c in text for c in NO_PROSE) or text.lower().startswith(CODE):
                return None
            letters, words = sum(c.isalpha() for c in text), len(text.split())
            if re.search("[぀-ヿ㐀-鿿가-힯]", text):
                sure = letters >= 4 and (letters >= 12 or any(c in text for c in "。！？!?"))
            else:
                sure = letters >= 10 and (words >= 6 or words >= 3 and text[-1] in ".!?")
            if not sure:
                return None
            out += _trimmed(data, at, at + len(line), PROSE, "")
        at += len(line) + 1
    return out or None


def _delimited(text: str) -> bool:
    """Whether all lines have the same number of fields, two or more, by a comma, a tab, a semicolon or a bar."""
    rows = [r for r in text.splitlines() if r.strip()]
    for sign in ",\t;|":
        widths = {len(re.findall(rf'(?:^|{re.escape(sign)})(?:"(?:[^"]|"")*"|[^"{re.escape(sign)}]*)(?={re.escape(sign)}|$)', r)) for r in rows}
        if len(widths) == 1 and widths.pop() >= 2:
            return True
    return False


def scan(text: str | None, name: str = "") -> tuple[str | None, list[Span]]:
    """The format and the spans of a file's text; no format for what no scanner takes. name: what the file is called."""
    data = (text or "").encode()
    hint = {"ini": "ini", "cfg": "ini", "conf": "ini", "toml": "toml", "yaml": "yaml", "yml": "yaml"}.get(name.lower().rsplit(".", 1)[-1] if "." in name else "")
    if not data.strip() or "\0" in (text or ""):
        return None, []
    for kind, scanner in (("json", json_spans), ("xml", xml_spans)):
        if (found := scanner(data)) is not None:
            return kind, found
    if data.lstrip()[:1] in (b"{", b"<") or hint is None and _delimited(text or ""):
        return None, []
    if (settings := setting_spans(data, hint)) is not None:
        return settings
    if hint is None and (found := prose_spans(data)) is not None:
        return "prose", found
    return None, []


def spans(files: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """file, hash, format, nth (from 0 in a file), start, end (bytes), style, path and text of all strings of the files, machine keys' and all."""

    def parse(named: str) -> Iterator[tuple]:
        name, text = named.split("\0", 1)
        kind, found = scan(text, name)
        return ((kind, k, *s) for k, s in enumerate(found))

    named = F.concat(F.coalesce(F.col(file_col).cast("string"), F.lit("")), F.lit("\0"), F.coalesce(text_col, F.lit("")))
    df = files.select(F.col(file_col).alias("file"), F.sha2(text_col, 256).alias("hash"), named.alias("__named"))
    return exploded(df, "__named", ("file", "hash"), "format string, nth long, start long, end long, style string, path string, text string", parse)


def for_people() -> Column:
    """Of spans(): no key of the path is for programs, and the text reads like one."""
    machine = F.exists(F.split("path", "/"), prose.machine_key)
    return prose.human_text(F.col("text")) & (~machine | F.col("format").isin("xml", "prose"))


def span_units(files: DataFrame, source: Column, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """A unit for each span in the source language that is for people, with its anchor: file, hash, start, end, style."""
    own = spans(files, file_col, text_col).where(for_people() & scripts.needs_translation(F.col("text"), source))
    own = own.withColumn("location", F.format_string("%s#auto:%d:%d", F.col("file").cast("string"), "start", "end")).withColumn("original_lines", F.array("text"))
    return own.select("file", "hash", "start", "end", "style", "format", ids.unit_id(F.lit("auto"), F.col("location"), F.col("original_lines")).alias("id"), "location", "original_lines")


def resolved(anchors: DataFrame, files: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """anchors with reason: null where an anchor (file, hash, start, end, style) meets a span of the files (file and text) as they are, else why it
    is refused."""
    fresh = spans(files) if fresh is None else fresh
    known = files.select("file", F.sha2("text", 256).alias("hash_now"))
    here = fresh.select("file", "start", "end", F.col("style").alias("style_now"))
    out = anchors.join(known, "file", "left").join(here, ["file", "start", "end"], "left")
    reason = F.when(F.col("hash_now").isNull(), "no such file").when(F.col("hash_now") != F.col("hash"), "the file has changed").when(F.col("style_now").isNull(), "no span at these bytes").when(F.col("style_now") != F.col("style"), "another style")
    return out.select(*anchors.columns, reason.alias("reason"))


def literal(text: Column, style: Column) -> Column:
    """A text as a style writes it; null where it cannot be written."""
    quoted = F.to_json(F.struct(text.alias("t")))
    quoted = F.substring(quoted, F.lit(6), F.char_length(quoted) - 6)
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    single = F.when(text.rlike("['\n\r]"), quoted).otherwise(F.concat(F.lit("'"), text, F.lit("'")))
    single_yaml = F.when(text.rlike("[\n\r\t]"), quoted).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")))
    bare = F.when(text.rlike(r"[\n\r\\#;\"']") | (scripts.trim(text) != text) | (text == ""), quoted).otherwise(text)
    made = F.when(style == XML, escaped).when(style == SINGLE, single).when(style == SINGLE_YAML, single_yaml).when(style == BARE_INI, bare).when(style == PROSE, F.when(~text.rlike("[\n\r]"), text)).otherwise(quoted)
    return F.when(~text.rlike(r"[\p{Cc}&&[^\n\r\t]]"), made)


def edited(files: DataFrame, edits: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """file, text and reason: each file with its edits (file, hash, start, end, style, translation), or as it was, with why. Files without
    edits stay, byte for byte. All of a file's edits are made, or none."""
    one = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), literal(F.col("translation"), F.col("style")).alias("literal"), "style", "hash", "translation")
    per_file = edits.groupBy("file").agg(F.sort_array(F.collect_set(one)).alias("__edits"))
    own = files.select(F.col(file_col).alias("file"), F.col(text_col).alias("__text")).join(per_file, "file", "left").withColumn("__name", F.col("file").cast("string"))
    out = batches.added(own, ["__text", "__edits", "__name"], {"text": ("string", pa.string()), "reason": ("string", pa.string())}, rewritten)
    return out.select("file", "text", "reason")


def rewritten(text: str | None, edits: list[dict] | None, name: str | None = "") -> tuple[str | None, str | None]:
    """A file's text with its edits, sorted by their place, and no reason, or as it was and why."""
    if not edits:
        return text, None
    if text is None:
        return text, "no such file"
    data = text.encode()
    now = hashlib.sha256(data).hexdigest()
    kind, old = scan(text, name or "")
    styles = {(start, end): style for start, end, style, _, _ in old}
    for e in edits:
        if e["hash"] is not None and e["hash"] != now:
            return text, "the file has changed"
        if (found := styles.get((e["start"], e["end"]))) is None:
            return text, "no span at these bytes"
        if e["style"] is not None and e["style"] != found:
            return text, "another style"
        if e["literal"] is None:
            return text, "not to be written so"
    if any(a["end"] > b["start"] for a, b in itertools.pairwise(edits)):
        return text, "edits overlap"
    edges = [0, *(x for e in edits for x in (e["start"], e["end"])), len(data)]
    kept = [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
    made = b"".join(x for pair in zip(kept, [*(e["literal"].encode() for e in edits), b""], strict=True) for x in pair).decode()
    # The new file's spans are the old ones, with the new texts.
    new = {(e["start"], e["end"]): e["translation"] for e in edits}
    wanted = [(_style_class(style), path, new.get((start, end), own)) for start, end, style, path, own in old]
    again, fresh = scan(made, name or "")
    if again != kind or [(_style_class(style), path, own) for _, _, style, path, own in fresh] != wanted:
        return text, "the structure has changed"
    return made, None


def _style_class(style: str) -> str:
    """Styles of settings count as one: a value may need quotation marks once it is translated."""
    return style if style in (JSON, XML, PROSE) else "value"


def coverage(files: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """format, files and spans: how many files each scanner took (none: format null), and what it found."""
    own = spans(files, file_col, text_col).groupBy("file", "format").agg(F.count("*").alias("n"))
    names = files.select(F.col(file_col).alias("file"))
    return names.join(own, "file", "left").groupBy("format").agg(F.count("*").alias("files"), F.sum(F.coalesce("n", F.lit(0))).alias("spans"))
