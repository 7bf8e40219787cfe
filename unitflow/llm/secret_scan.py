"""Secret scan: patterns of known secrets, and strings whose characters look drawn at random.

Candidate strings are runs of letters, digits and +/_=-. Each belongs to a character class (hexadecimal or
mixed); a window slides over it with counts that change by the character that enters and the one that leaves, and
the largest Shannon entropy of a window decides by the class. An allow-list suppresses plain words, numbers and
UUIDs. DataFrame functions only.

A null text is an empty text without spans. Rows that repeat are scanned each; ids may be null; an empty table gives
an empty result. Offsets are code points, the end is exclusive. Texts of any length are scanned whole, in time that grows with their length; other columns,
whatever their names, are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.llm.shared import keyed

#: kind: pattern of the whole match, pattern of what decides its least length, group, least length.
KINDS = {
    "assign": (r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]+", 0, 24),
}
#: What a text must hold for a kind's pattern to be worth matching.
HINTS = {"assign": r"(?i)passw|secret|token|api_?key", "access": r"AKIA", "hex": r"[0-9a-f]{24}"}
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Candidates that are no secrets: words and compounds without digits of one case or capitalised, numbers, UUIDs. Java's expressions recurse for each turn of a
#: group, unless it is possessive; so no pattern here or in pii has a group that is repeated without bound in any other way.
ALLOWED = r"^(?:[a-z_=/+-]+|[A-Z_=/+-]+|[A-Z]?[a-z]++(?:[-_/=+][A-Z]?[a-z]++)*+[-_/=+]*|[0-9_=/+-]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"
WINDOW = 20
#: Elements that a running sum folds at once.
BLOCK = 256
HEX_BITS = 3.0
MIXED_BITS = 3.8


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, add=lambda s, x: s + x) -> Column:
    """The sum (or another fold from 0) of the elements before each one. Folded in blocks, since a fold that appends to an array
    copies it: n elements cost n * BLOCK / 2 copies and not n * n / 2."""
    total = lambda xs, start: F.aggregate(xs, start, add)
    empty = lambda start: F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    fold = lambda xs, start: F.aggregate(xs, empty(start), lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
    last = F.greatest(F.floor((F.size(values) - 1) / BLOCK).cast("int"), F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))
    return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, fold(F.transform(bs, lambda b: total(b, F.lit(0))), F.lit(0)), fold)))


def _spans(pattern: str, hint: str, group: int, least: int, kind: str, order: int) -> Column:
    """Spans of a pattern's leftmost matches, from the lengths of the matches and of what lies between them."""
    text = F.col("text")
    parts = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    size = lambda x: F.coalesce(F.char_length(x), F.lit(0))
    span = "struct<start:int,rank:int,end:int,kind:string,hit:string>"

    def placed(ps: Column) -> Column:
        lengths = F.transform(ps, lambda x: size(x["gap"]) + size(x["all"]))
        made = F.zip_with(ps, _let(lengths, lambda v: _running(v)), lambda x, at: F.when(size(x["part"]) >= least, F.struct((at + size(x["gap"])).alias("start"), F.lit(order).alias("rank"), (at + size(x["gap"]) + size(x["all"])).alias("end"), F.lit(kind).alias("kind"), x["all"].alias("hit"))))
        return F.array_compact(made).cast(f"array<{span}>")

    return F.when(text.rlike(hint), _let(parts, placed)).otherwise(F.array().cast(f"array<{span}>"))


def window_entropy(hit: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of a window that slides over a string of ASCII characters, by incremental counts: a step
    adds the term of the character that enters and takes off that of the one that leaves. Their counts come from the window
    itself, so a step costs the window's length, whatever the string's."""
    terms = F.array(*(F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(window + 1)))
    most = window * math.log2(window)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(most).alias("least"), F.lit(0).alias("at"))

    def slide(codes: Column, terms: Column):
        def step(acc: Column, code: Column) -> Column:
            full = acc["at"] >= window
            before = F.slice(codes, F.greatest(acc["at"] - window, F.lit(0)) + 1, F.least(acc["at"], F.lit(window)))
            leaves = F.when(full, F.get(codes, acc["at"] - window))
            seen = lambda xs, c: F.size(xs) - F.size(F.array_remove(xs, c))
            counts = _let(before, lambda xs: F.struct(seen(xs, code).alias("into"), F.when(full, seen(xs, leaves) + (leaves == code).cast("int")).alias("out")))
            term = lambda n: F.get(terms, n)
            s = _let(counts, lambda n: acc["s"] + term(n["into"] + 1) - term(n["into"]) + F.when(full, term(n["out"] - 1) - term(n["out"])).otherwise(F.lit(0.0)))
            least = lambda x: F.when(acc["at"] + 1 >= window, F.least(acc["least"], x)).otherwise(acc["least"])
            return _let(s, lambda x: F.struct(x.alias("s"), least(x).alias("least"), (acc["at"] + 1).alias("at")))

        return step

    codes = F.transform(F.split(hit, ""), lambda c: F.ascii(c))
    return _let(codes, lambda cs: _let(terms, lambda ts: F.lit(math.log2(window)) - F.aggregate(cs, start, slide(cs, ts))["least"] / window))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hex_bits: float = HEX_BITS, mixed_bits: float = MIXED_BITS, allowed: str = ALLOWED) -> DataFrame:
    """One row per document: doc_id, base and spans, arrays of (start, rank, end, kind, hit) ordered by start, then kind.

    base holds the spans of KINDS; spans adds those of random-looking strings (kind entropy) that no base span covers.
    """
    df = keyed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kinds = [_spans(p, HINTS[k], g, n, k, i).alias(k) for i, (k, (p, g, n)) in enumerate(KINDS.items())]
    found = _spans(CANDIDATE, r"[A-Za-z0-9+/_=-]{20}", 0, WINDOW, "entropy", len(KINDS)).alias("found")
    df = df.select("doc_id", *kinds, found)
    df = df.select("doc_id", F.sort_array(F.concat(*KINDS)).alias("base"), F.filter("found", lambda x: ~x["hit"].rlike(allowed)).alias("found"))
    # In order of start, a candidate lies inside a base span if one before it ends no earlier.
    inside = lambda xs: F.zip_with(xs, _let(F.transform(xs, lambda x: F.when(x["kind"] != "entropy", x["end"]).otherwise(0)), lambda ends: _running(ends, lambda s, x: F.greatest(s, x))), lambda x, end: F.when((x["kind"] == "entropy") & (end < x["end"]), x))
    outside = F.when(F.size("found") > 0, F.array_compact(_let(F.sort_array(F.concat("base", "found")), inside))).otherwise(F.col("found"))
    df = df.select("doc_id", "base", outside.alias("found"))
    random = F.filter("found", lambda x: window_entropy(x["hit"]) >= F.when(x["hit"].rlike("^[0-9a-fA-F]+$"), F.lit(hex_bits)).otherwise(F.lit(mixed_bits)))
    return df.select("doc_id", "base", F.sort_array(F.concat("base", random)).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
