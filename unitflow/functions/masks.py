"""Spans that a translation must keep: controls, placeholders and tags."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from unitflow.functions.scripts import let

# The grammar of what is kept.
CONTROL = r"\\{2}|\\[A-Za-z]+\[[^\]\r\n]*\]|\\[!.>|{\}\\\$\^]|\\[A-Za-z]"
BRACE = r"\{\{\s*[A-Za-z_][A-Za-z0-9_.]*\s*\}\}|\{[A-Za-z_][A-Za-z0-9_]*\}|\{\d+(?:,-?\d+)?(?::[^{}\r\n]+)?\}"
PRINTF = r"%(?:\d+\$)?[-+#0]*(?:\d+|\*(?:\d+\$)?)?(?:\.(?:\d+|\*(?:\d+\$)?))?(?:hh|ll|[hlLjzt])?[diuoxXfFeEgGaAcspn]|%%"
MASK = r"\[CTRL_\d+\]"
TAG = r"""</?[A-Za-z][A-Za-z0-9:_-]*(?:\s+[A-Za-z_:][A-Za-z0-9_:.-]*(?:\s*=\s*(?:"[^"\r\n]*"|'[^'\r\n]*'|[^\s<>"'=]+))?)*\s*/?>"""
BRACKET = r"\[[A-Za-z_][A-Za-z0-9_]*(?:![a-z]+)?\]"
CORE = (CONTROL, BRACE, PRINTF, MASK)
MARKUP = (*CORE, TAG)
# Formats whose text is markup.
MARKUP_ENGINES = ("auto", "epub", "html", "xml", "md", "docx", "srt", "vtt")

MASKED = "struct<masked:array<string>,literals:array<string>,visible:array<string>>"


@lru_cache(8)
def _compiled(rules: tuple[str, ...]) -> list[re.Pattern]:
    return [re.compile(r) for r in rules]


def literal_spans(text: str, rules: tuple[str, ...] = CORE) -> list[tuple[int, int]]:
    """Spans of all rules' matches that don't overlap: the earliest, and of those that begin together the longest."""
    longest: dict[int, int] = {}
    for rule in _compiled(rules):
        for m in rule.finditer(text):
            longest[m.start()] = max(m.end(), longest.get(m.start(), 0))
    kept: list[tuple[int, int]] = []
    for start in sorted(longest):
        if longest[start] > start >= (kept[-1][1] if kept else 0):
            kept.append((start, longest[start]))
    return kept


def mask_lines(lines: list[str], rules: tuple[str, ...] = CORE) -> tuple[list[str], list[str], list[str]]:
    """The lines with spans as [CTRL_n], numbered through the unit; the literals by number; the lines with a space for each span."""
    masked, literals, visible = [], [], []
    for line in lines:
        spans = literal_spans(line, rules)
        gaps = [line[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(line)], strict=True)]
        tokens = [f"[CTRL_{len(literals) + k}]" for k in range(len(spans))]
        literals += [line[a:b] for a, b in spans]
        masked.append("".join(x for pair in zip(gaps, [*tokens, ""], strict=True) for x in pair))
        visible.append(" ".join(gaps))
    return masked, literals, visible


def unmask_line(line: str, literals: list[str]) -> str:
    """The line with known masks replaced, once; unknown ones stay."""
    return re.sub(r"\[CTRL_(0|[1-9]\d*)\]", lambda m: literals[int(m[1])] if int(m[1]) < len(literals) else m[0], line)


@lru_cache(4096)
def _any_of(literals: frozenset[str]) -> re.Pattern:
    return re.compile("|".join(sorted(map(re.escape, literals), key=len, reverse=True)))


def lost_tokens(lines: list[str], literals: list[str]) -> int:
    """How many occurrences of the literals a translation lacks. An alternation of them, longest first, says which of those that overlap
    is there; what it finds is taken off what is wanted."""
    wanted = Counter(literals)
    present = Counter(_any_of(frozenset(wanted) - {""}).findall("\n".join(lines))) if any(literals) else Counter()
    return (wanted - present).total()


def masked(lines: Column, rules: tuple[str, ...] = CORE) -> Column:
    """struct(masked, literals, visible) of an array of lines; null for null. Vectorised: one Arrow batch at a time."""

    @F.pandas_udf(MASKED)
    def run(s: pd.Series) -> pd.DataFrame:
        found = [(None, None, None) if x is None else mask_lines(list(x), rules) for x in s]
        return pd.DataFrame({name: [f[k] for f in found] for k, name in enumerate(("masked", "literals", "visible"))})

    # Every literal begins with one of four signs, so lines without them are told by Spark.
    may = F.exists(lines, lambda x: x.rlike(r"[\\{%\[<]"))
    plain = F.struct(lines.alias("masked"), F.array().cast("array<string>").alias("literals"), lines.alias("visible"))
    if not set(rules) <= {CONTROL, BRACE, PRINTF, MASK, TAG, BRACKET}:
        return run(lines)
    return F.when(F.coalesce(may, F.lit(True)), run(F.when(F.coalesce(may, F.lit(True)), lines))).otherwise(plain)


def unmasked(lines: Column, literals: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [unmask_line(y, [] if k is None else list(k)) for y in x] for x, k in zip(s, known, strict=True)])

    return run(lines, literals)


def lost(lines: Column, literals: Column) -> Column:
    @F.pandas_udf("long")
    def run(s: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([lost_tokens([] if x is None else list(x), [] if k is None else list(k)) for x, k in zip(s, known, strict=True)], dtype="int64")

    lines, literals = (F.col(c) if isinstance(c, str) else c for c in (lines, literals))
    some = F.coalesce(F.size(literals) > 0, F.lit(False))
    return F.when(some, run(F.when(some, lines), F.when(some, literals))).otherwise(F.lit(0).cast("long"))


def rules_for(engine: str) -> tuple[str, ...]:
    """The rules of a format: the core, brackets in Ren'Py scripts, tags where text is markup."""
    return (*CORE, *([BRACKET] if engine == "renpy" else []), *([TAG] if engine in MARKUP_ENGINES else []))


def reorderable(literal: Column) -> Column:
    """Whether a literal may change places with others: named and numbered placeholders may, controls and tags may not."""
    return ~literal.startswith("[CTRL_") & literal.rlike(f"^(?:{BRACE}|{BRACKET})$") | literal.rlike(r"^%[0-9]+\$")


def _first(faults: Column) -> Column:
    return F.get(F.array_compact(faults), F.lit(0))


def _before(flags: Column, k: Column) -> Column:
    """How many of the flags before place k are set."""
    return F.size(F.filter(F.slice(flags, F.lit(1), k), lambda f: f))


def literal_fault(actual: Column, expected: Column) -> Column:
    """What is wrong with a translation's literals, given those of its source, or null: none may be new or more, those with a fixed place keep
    their order, none may be missing."""
    times = lambda xs, y: F.size(F.filter(xs, lambda x: x == y))

    def faults(wanted: Column, fixed: Column) -> Column:
        moved = lambda x, k: F.get(fixed, k) & ~F.get(wanted, _before(fixed, k)).eqNullSafe(x)
        return F.transform(actual, lambda x, k: F.when(times(F.slice(actual, F.lit(1), k), x) >= times(expected, x), "unexpected literal").when(moved(x, k), "literals out of order"))

    found = let(F.filter(expected, lambda x: ~reorderable(x)), lambda wanted: let(F.transform(actual, lambda x: ~reorderable(x)), lambda fixed: faults(wanted, fixed)))
    return F.coalesce(_first(found), F.when(F.size(actual) < F.size(expected), "missing literal"))


def mask_fault(lines: Column, literals: Column) -> Column:
    """What is wrong with the masks of an answer, given the literals by number, or null: each is there once, and those with a fixed place
    keep their order."""
    tokens = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(MASK), F.lit(0))))
    number = lambda t: F.regexp_extract(t, r"^\[CTRL_(0|[1-9][0-9]{0,8})\]$", 1).try_cast("int")
    in_order = F.array_compact(F.transform(literals, lambda x, i: F.when(~reorderable(x), i)))

    def faults(found: Column, numbers: Column, fixed: Column, wanted: Column) -> Column:
        unknown = lambda k: F.get(literals, F.get(numbers, k)).isNull()
        moved = lambda k: F.get(fixed, k) & ~F.get(wanted, _before(fixed, k)).eqNullSafe(F.get(numbers, k))
        return F.transform(found, lambda t, k: F.when(unknown(k), "unknown mask").when(F.array_contains(F.slice(found, F.lit(1), k), t), "mask twice").when(moved(k), "masks out of order"))

    def fault(found: Column) -> Column:
        placed = lambda ns: F.transform(ns, lambda n: F.coalesce(~reorderable(F.get(literals, n)), F.lit(False)))
        every = let(F.transform(found, number), lambda ns: let(placed(ns), lambda fixed: let(in_order, lambda wanted: faults(found, ns, fixed, wanted))))
        return F.coalesce(_first(every), F.when(F.size(found) < F.size(literals), "missing mask"))

    return let(tokens, fault)
