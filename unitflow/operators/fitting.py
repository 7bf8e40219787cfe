"""Translations fitted into a fixed number of slots, by rules of labels, controls and widths.

A rule is for a domain (or any) and says what a speaker's label looks like, what is a control that takes no room, and how wide a slot is.
Rules are few and sent with the tasks. Units that are in order already are told by Spark expressions and pass as they are; the others are fitted in Arrow
batches, as places of breaks depend on what went before.

Line breaks: of the places where a line may end within the width, the last after closing punctuation, else the last after a space, if what is left
then still fits the other slots; else the last that parts neither a word nor an opening mark from what follows; else any; else the end of a label. No break lies inside a
label or a control, or before closing punctuation. The last slot takes the rest, however wide; text is never dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.functions import scripts

# Marks that may not begin a line, and marks that may not end one.
CLOSING = "，。！？、」』；：…〗〕》〉］｝,.!?;:)）】]}”’"
OPENING = "「『（(【〖〔《〈［[｛{“‘\"'"
#: Where controls before a label go if the source's label had none: into the text, or they stay.
BODY, LABEL = "body", "label"
UNBOUNDED = 1 << 62


@dataclass(frozen=True)
class Rule:
    """label and control are regular expressions; none where empty. width 0 is no limit; an empty domain is any."""

    label: str = ""
    control: str = ""
    width: int = 0
    leading: str = BODY
    domain: str = ""
    layer: int = 0

    def __post_init__(self):
        for pattern in (self.label, self.control):
            if pattern and re.search(pattern, ""):
                raise ValueError(f"a pattern must not match an empty text: {pattern}")


def ordered(rules: list[Rule]) -> tuple[Rule, ...]:
    """Higher layers first, then rules for a domain, then the wider; equal ones as they stand."""
    return tuple(sorted(rules, key=lambda r: (-r.layer, not r.domain, -r.width)))


def effective_width(rules: list[Rule], domain: str = "") -> int | None:
    """The width that holds for a domain, or for all that rules have."""
    return next((r.width for r in ordered(rules) if r.width and (not domain or r.domain in ("", domain))), None)


def probe(rules: list[Rule], text: str, domain: str = "") -> tuple[Rule, str, str, str] | None:
    """The first rule that finds a label at the start of a text: it, what stands before, the label, and the rest."""
    for r in ordered(rules):
        if not domain or r.domain in ("", domain):
            if parts := _fitter(r).leading(text):
                return r, *parts
    return None


@lru_cache(64)
def _compiled(pattern: str) -> re.Pattern | None:
    return re.compile(pattern) if pattern else None


def _word(c: str) -> bool:
    return c.isascii() and c.isalnum()


class _Kinds(dict):
    """Of each character met: its cells, and whether it closes, opens, is blank, or is of a word."""

    def __missing__(self, c: str) -> tuple[int, bool, bool, bool, bool]:
        self[c] = found = (1 if c < "\x80" else 2, c in CLOSING, c in OPENING, c.isspace(), _word(c))
        return found


_KINDS = _Kinds()
_KINDS[""] = (0, False, False, False, False)


@lru_cache(64)
def _fitter(rule: Rule) -> _Fitter:
    return _Fitter(rule)


class _Fitter:
    """Fits the lines of one rule."""

    def __init__(self, rule: Rule):
        self.rule, self.label, self.control = rule, _compiled(rule.label), _compiled(rule.control)
        self.token = _compiled(f"(?s:(?P<control>{rule.control})|.)" if rule.control else "(?s:.)")

    def tokens(self, text: str) -> tuple[Sequence[int], Sequence[str]]:
        """The start of each token and of the end, and each token's character, none for a control. A text without controls is its own tokens."""
        if not self.control or not self.control.search(text):
            return range(len(text) + 1), text
        found = list(self.token.finditer(text))
        seen = ["" if self.control and m["control"] else m[0] for m in found]
        return [m.start() for m in found] + [len(text)], seen

    def width(self, text: str) -> int:
        seen = self.tokens(text)[1]
        return len(seen) if isinstance(seen, str) and seen.isascii() else sum(_KINDS[c][0] for c in seen)

    def lead(self, text: str) -> int:
        """Where controls and white space at the start end."""
        at = 0
        while at < len(text):
            m = self.control.match(text, at) if self.control else None
            if m:
                at = m.end()
            elif text[at].isspace():
                at += 1
            else:
                break
        return at

    def leading(self, text: str) -> tuple[str, str, str] | None:
        """What stands before a label at the start of a text, the label, and the rest."""
        at = self.lead(text)
        m = self.label.match(text[at:]) if self.label else None
        if not m or not m[0] or not _shows(m[0]):
            return None
        return text[:at], m[0], text[at + m.end() :]

    def alone(self, text: str) -> tuple[str, str, str] | None:
        """leading(), if nothing but controls and white space follows."""
        parts = self.leading(text)
        return parts if parts and self.lead(parts[2]) == len(parts[2]) else None

    def controls(self, text: str) -> bool:
        return bool(self.control) and self.control.search(text) is not None

    def closes(self, text: str) -> bool:
        at = self.lead(text)
        return at < len(text) and text[at] in CLOSING

    def reflowed(self, text: str, n: int, width: int) -> list[str]:
        """A text in n lines, of which only the last may be too wide."""
        text = text.replace("\n", "")
        if n <= 1:
            return [text][:n]
        starts, seen = self.tokens(text)
        many = len(seen)
        parts = self.leading(text)
        label_end = len(parts[0]) + len(parts[1]) if parts else 0
        table = np.array([_KINDS[c] for c in seen], np.int64).reshape(many, 5)
        room, closing, opening, blank, word = table[:, 0], *(table[:, 1:].T.astype(bool))
        upto = np.concatenate([[0], np.cumsum(room)])
        # What may stand at the end of a line, by the token before the break: any, safe, space, punctuation. The next token with a mark must not close.
        place = np.arange(many)
        marks = np.where((room > 0) & ~blank, place, many)
        after = np.append(np.minimum.accumulate(marks[::-1])[::-1], many)[1:]
        ends = np.array(starts[1:], np.int64)
        able = (room > 0) & (ends >= label_end) & ~np.append(closing, False)[after]
        # A word goes on where the next character of the text is of a word, the first one of a control too.
        goes_on = np.append(word[1:], False) if isinstance(seen, str) else np.array([e < len(text) and _word(text[e]) for e in ends], bool)
        safe = able & ~(word & goes_on) & ~opening
        kinds = np.array([able, safe, safe & blank, safe & closing])
        latest = np.maximum.accumulate(np.where(kinds, place, -1), axis=1) if many else kinds
        in_label = int(np.searchsorted(starts[:-1], label_end)) if label_end else 0  # tokens that begin inside the label
        limits, lines, start = upto.tolist(), [], 0
        while start < many and len(lines) + 1 < n:
            end = max(bisect_right(limits, limits[start] + width) - 1, in_label)
            if end >= many:
                break
            rest, slots = limits[many] - limits[start], n - len(lines)
            fits = lambda k: limits[many] - limits[k + 1] <= (slots - 1) * width or rest > slots * width  # noqa: B023, E731
            any_, safe, space, mark = (int(k) if k >= start else None for k in latest[:, end - 1]) if end > start else (None,) * 4
            cut = next((k for k in (mark, space) if k is not None and fits(k)), None)
            cut = next((k for k in (cut, safe, any_) if k is not None), None)
            if cut is None and start < in_label <= end and starts[in_label] == label_end and seen[in_label - 1]:
                cut = in_label - 1
            if cut is None:
                lines += [""] * (n - 1 - len(lines))
                break
            lines.append(text[starts[start] : starts[cut + 1]])
            start = cut + 1
        if start < many:
            lines.append(text[starts[start] :])
        return lines + [""] * (n - len(lines))

    def lines(self, lines: list[str], n: int, width: int) -> list[str]:
        """Lines in n slots: as they are up to the first that is too wide or stands before closing punctuation, reflowed from there."""
        if n == 0:
            return []
        for k, line in enumerate(lines[: n - 1]):
            orphan = width != UNBOUNDED and k + 1 < len(lines) and self.closes(lines[k + 1])
            if orphan or self.width(line) > width:
                return lines[:k] + self.reflowed("".join(lines[k:]), n - k, width)
        if len(lines) < n:
            return lines + [""] * (n - len(lines))
        return [*lines[: n - 1], "".join(lines[n - 1 :])]

    def fit(self, lines: list[str], original: list[str], n: int, width: int) -> list[str]:
        """Lines in n slots; a label that has the first slot, here or in the source, keeps it."""
        if n < 2 or not lines:
            return self.lines(lines, n, width)
        own = self.alone(original[0]) if original else None
        here = self.alone(lines[0])
        if here:
            if own and self.rule.leading == BODY and not self.controls(own[0]) and self.controls(here[0]):
                return [here[1], *self.lines([here[0] + "".join(lines[1:2]), *lines[2:]], n - 1, width)]
            return [lines[0], *self.lines(lines[1:], n - 1, width)]
        if own:
            parts = self.leading(lines[0])
            if not parts:
                return [original[0], *self.lines(lines, n - 1, width)]
            first = parts[0] + parts[2]
            return [parts[1], *self.lines([first] * bool(first) + lines[1:], n - 1, width)]
        return self.lines(lines, n, width)


def _shows(label: str) -> bool:
    """Whether a label has text between its marks, or no marks."""
    if label[0].isalnum() or label[-1].isalnum():
        return True
    inner = label[1:-1]
    return label[0] not in inner and label[-1] not in inner and inner.strip() != ""


def fit_one(domain: str, original: list[str], lines: list[str], n: int, rules: tuple[Rule, ...]) -> tuple[list[str], int]:
    """Fitted lines, and how many of them are too wide. rules: ordered()."""
    own = [r for r in rules if r.domain in ("", domain)]
    if not n or not lines or not own:
        return lines, 0
    width = next((r.width for r in own if r.width), 0)
    found = [next((r for r in own if _fitter(r).leading(x)), None) for x in (original[:1] or [""]) + lines[:1]]
    fitter = _fitter(found[0] or found[1] or own[0])
    fitted = fitter.fit(lines, original, n, width or UNBOUNDED)
    return fitted, sum(fitter.width(x) > width for x in fitted) if width else 0


def _settled(domain: Column, original: Column, lines: Column, n: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether fitting surely changes nothing, and no slot is too wide: as many lines as slots, no label anywhere, no line too wide, none
    that begins with closing punctuation."""
    least = min((r.width for r in rules if r.width), default=0)

    def fine(r: Rule) -> Column:
        shown = lambda x: F.regexp_replace(x, rf"(?:{r.control})|\s" if r.control else r"\s", "")
        amiss = lambda x: F.left(shown(x), F.lit(1)).isin(*CLOSING)
        wide = lambda x: scripts.display_width(x, r.control) > least
        out = ~F.exists(lines, amiss)
        if least:
            out &= ~F.exists(lines, wide)
        if r.label:
            out &= ~F.exists(F.concat(F.slice(original, 1, 1), F.slice(lines, 1, 1)), lambda x: x.rlike(r.label.lstrip("^")))
        return out

    quiet = F.lit(True)
    for r in rules:
        quiet &= fine(r) | (F.lit(False) if not r.domain else domain != r.domain)
    return (F.size(lines) == n) & quiet


def fitted(units: DataFrame, rules: list[Rule], n: Column) -> DataFrame:
    """units with fit: lines in n slots each (array<string>), reflowed (whether they differ), and overflow_lines. units: domain, original_lines and lines.

    A unit whose domain no rule is for stays as it is. Null lines, or no slots, stay as they are.
    """
    rules_ = ordered(rules)
    df = units.withColumn("__n", n.cast("int"))

    @F.pandas_udf("struct<lines:array<string>,overflow:int>")
    def run(domain: pd.Series, original: pd.Series, lines: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = [(None, 0) if x is None else fit_one(d, [] if o is None else list(o), list(x), int(k), rules_) for d, o, x, k in zip(domain, original, lines, n.fillna(0), strict=True)]
        return pd.DataFrame({"lines": [a for a, _ in out], "overflow": [b for _, b in out]})

    settled = F.coalesce(_settled(F.col("domain"), F.col("original_lines"), F.col("lines"), F.col("__n"), rules_), F.lit(False))
    made = F.when(~F.col("__settled"), run(F.col("domain"), *(F.when(~F.col("__settled"), F.col(c)) for c in ("original_lines", "lines")), F.col("__n")))
    df = df.withColumn("__settled", settled).withColumn("__made", made)
    lines = F.when(F.col("__settled"), F.col("lines")).otherwise(F.col("__made.lines"))
    df = df.withColumn("fit", F.struct(lines.alias("lines"), F.coalesce(lines != F.col("lines"), F.lit(False)).alias("reflowed"), F.coalesce("__made.overflow", F.lit(0)).alias("overflow_lines")))
    return df.drop("__n", "__settled", "__made")


def overflow_counts(fits: DataFrame) -> DataFrame:
    """domain, units, reflowed (units), overflow_units and overflow_lines, from fitted()."""
    wide = F.col("fit.overflow_lines")
    return fits.groupBy("domain").agg(F.count("*").alias("units"), F.count_if("fit.reflowed").alias("reflowed"), F.count_if(wide > 0).alias("overflow_units"), F.sum(wide.cast("long")).alias("overflow_lines"))
