"""Translations put into shape before they are checked: line breaks, lines of literals alone, sounds left in by rote.

Lines are arrays of strings; all but the kana are Spark expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from unitflow.functions import kana, masks, scripts

# Blocks of wide characters besides kana and Han.
WIDE = "[" + scripts.KANA + scripts.CJK + r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3000}-\x{303F}\x{FF01}-\x{FF60}\x{FFE0}-\x{FFE6}]"
BLANK = r"[\s&&[^\n]]"


def joined(line: Column) -> Column:
    """A line for a slot of one line: a break between wide characters goes, one beside white space too, any other is a space."""
    # Each pattern begins with the break, so that only breaks cost a look around.
    out = F.regexp_replace(line, rf"\n(?<={WIDE}\n)(?={WIDE})", "")
    out = F.regexp_replace(out, rf"(?U)\n(?:(?<={BLANK}\n)\n*|(?<!\n\n)(?={BLANK}))", "")
    return F.regexp_replace(out, r"\n+", " ")


def sanitised(lines: Column, item_type: Column) -> Column:
    """Lines without carriage returns; breaks inside a line joined in short texts, new lines elsewhere; long texts without blank lines at the end."""
    plain = lambda x: F.regexp_replace(x, r"\r\n?", "\n")
    split = F.flatten(F.transform(lines, lambda x: F.split(plain(x), "\n")))
    out = F.when(item_type == "short_text", F.transform(lines, lambda x: joined(plain(x)))).otherwise(split)

    def cut(out: Column) -> Column:
        full = F.array_max(F.transform(out, lambda x, i: F.when(x.rlike(r"(?U)\S"), i + 1)))
        return F.when((item_type == "long_text") & full.isNotNull(), F.slice(out, F.lit(1), full)).otherwise(out)

    return scripts.let(out, cut)


def restored(lines: Column, original: Column, masked: Column) -> Column:
    """Blank lines take the source's line where that holds literals alone, if there are as many lines. masked: the source's lines with masks."""
    alone = lambda m: m.rlike(r"(?U)^(?:\s*+\[CTRL_[0-9]+\])++\s*$")
    zipped = F.arrays_zip(lines.alias("line"), original.alias("own"), masked.alias("mask"))
    put = F.transform(zipped, lambda z: F.when(~z["line"].rlike(r"(?U)\S") & alone(z["mask"]), z["own"]).otherwise(z["line"]))
    return F.when(F.size(lines) == F.size(original), put).otherwise(lines)


def _ranges(java: str) -> str:
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), java)


_KANA, _HAN = re.compile(_ranges(scripts.KANA)), re.compile(_ranges(scripts.CJK))
_RUN = re.compile(_KANA.pattern + "+")
_QUOTE = re.compile(kana.QUOTES)
_MECHANICAL = re.compile(kana.MECHANICAL)
_EVIDENCE = re.compile(f"[{kana.CHINESE_CHARACTERS}]|{kana.CHINESE_WORDS}")
_SOUND = re.compile("っすよ?|[っッー]")


def _spaced(text: str, spans: list[tuple[int, int]]) -> str:
    for start, end in reversed(spans):
        text = f"{text[:start]} {text[end:]}"
    return text


def _chinese(text: str) -> bool:
    """kana.chinese_context() of a plain string."""
    han, runs = len(_HAN.findall(text)), _RUN.findall(text)
    strong = re.search(f"[{kana.CHINESE_CHARACTERS}]", text) is not None
    evident = _EVIDENCE.search(text) is not None or han >= 2 and re.search("[了的]", text) is not None
    other = sum(len(r) for r in runs if not _MECHANICAL.match(r))
    return han > 0 and evident and han >= other and (strong or not any(r in kana.PARTICLES for r in runs))


def without_sounds(line: str, rules: tuple[str, ...] = masks.CORE) -> str:
    """A Chinese line without kana that stand for a sound alone. Only where the line outside literals and Japanese quotations is evidently
    Chinese, has kana, and none of another kind; literals and Japanese quotations stay."""
    if not _KANA.search(line):
        return line
    visible = _spaced(line, masks.literal_spans(line, rules))
    japanese = lambda q: _KANA.search(q) is not None and not _chinese(q)
    outside = _spaced(visible, [m.span() for m in _QUOTE.finditer(visible) if japanese(m[0])])
    runs = _RUN.findall(outside)
    if not runs or not _EVIDENCE.search(outside) or not all(map(_MECHANICAL.match, runs)):
        return line
    kept = masks.literal_spans(line, rules) + [m.span() for m in _QUOTE.finditer(line) if japanese(_spaced(m[0], masks.literal_spans(m[0], rules)))]
    edges, at = [0], 0
    for start, end in sorted(kept):  # pairs of edges of what may change; spans that overlap count as one
        if end > at:
            edges += [max(start, at), end]
            at = end
    edges.append(len(line))
    sound = lambda m: "哦" if m[0].startswith("っす") else "～" if m[0] == "ー" else ""
    clean = lambda part: _RUN.sub(lambda r: _SOUND.sub(sound, r[0]) if _MECHANICAL.match(r[0]) else r[0], part)
    return "".join(clean(line[a:b]) if k % 2 == 0 else line[a:b] for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)))


def mechanical_kana(lines: Column, target: Column, rules: tuple[str, ...] = masks.CORE) -> Column:
    """Lines of a Chinese target without such kana; others as they are. Vectorised; only texts with kana are looked at."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [without_sounds(y, rules) for y in x])

    has = F.exists(lines, lambda x: x.rlike(scripts.KANA))
    return F.when((scripts.language(target) == "zh") & has, run(F.when(has, lines))).otherwise(lines)


def normalised(lines: Column, item_type: Column, original: Column, masked: Column, target: Column, rules: tuple[str, ...] = masks.CORE) -> Column:
    """All three, in order. masked: the source's lines with masks."""
    return mechanical_kana(restored(sanitised(lines, item_type), original, masked), target, rules)


def n_changed(before: Column, after: Column) -> Column:
    """Lines that differ, and those that one has more than the other."""
    zipped = F.arrays_zip(before.alias("a"), after.alias("b"))
    return F.size(F.filter(zipped, lambda z: ~z["a"].eqNullSafe(z["b"]))).cast("long")
