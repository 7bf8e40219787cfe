"""Predicates and measures of scripts and languages, as Spark expressions.

Every function takes and returns columns and stays inside Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code-point classes of scripts.
KANA = r"[\x{3041}-\x{3096}\x{3099}-\x{309F}\x{30A1}-\x{30FA}\x{30FC}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}\x{1B000}-\x{1B122}\x{1B132}\x{1B150}-\x{1B152}\x{1B155}\x{1B164}-\x{1B167}]"
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}\x{30000}-\x{323AF}]"
HANGUL = r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3131}-\x{318E}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}\x{FFA0}-\x{FFDC}&&\p{IsAlphabetic}]"
CYRILLIC = r"[\x{0400}-\x{052F}&&\p{IsAlphabetic}]"
ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}&&\p{IsAlphabetic}]"
DEVANAGARI = r"[\x{0900}-\x{097F}&&\p{IsAlphabetic}]"
THAI = r"[\x{0E00}-\x{0E7F}&&\p{IsAlphabetic}]"
LATIN = r"[\x{0041}-\x{024F}\x{1E00}-\x{1EFF}&&\p{IsAlphabetic}]"
# Language tags that share a script.
CYRILLIC_TAGS = ("ru", "uk", "bg", "be", "sr", "mk")
ARABIC_TAGS = ("ar", "fa", "ur")
DEVANAGARI_TAGS = ("hi", "mr", "ne")
LATIN_TAGS = ("de", "fr", "es", "it", "pt", "nl", "pl", "cs", "sk", "ro", "hu", "tr", "vi", "id", "ms", "sv", "no", "da", "fi")
ALIASES = {"jp": "ja", "jpn": "ja", "zho": "zh", "chi": "zh", "cn": "zh", "eng": "en", "kor": "ko"}
# Extensions of files a program loads.
ASSET_EXTENSIONS = "png jpg jpeg ogg m4a wav json js css webm".split()


def trim(text: Column) -> Column:
    """Without white space of any kind at either end; Spark's own trim takes off spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def language(tag: Column) -> Column:
    """The primary subtag in lower case, by its two-letter name."""
    base = F.lower(F.regexp_extract(trim(tag), r"^[^-_]*", 0))
    out = base
    for alias, name in ALIASES.items():
        out = F.when(base == alias, name).otherwise(out)
    return out


def needs_translation(text: Column, tag: Column) -> Column:
    """Whether a text is in the script of its source language; for other tags, whether it holds any letter."""
    base = language(tag)
    letters = F.char_length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return (
        F.when(base == "ja", text.rlike(KANA) | text.rlike(CJK))
        .when(base == "zh", text.rlike(CJK))
        .when(base == "en", letters >= 3)
        .when(base == "ko", text.rlike(HANGUL))
        .when(base.isin(*CYRILLIC_TAGS), text.rlike(CYRILLIC))
        .when(base.isin(*ARABIC_TAGS), text.rlike(ARABIC))
        .when(base.isin(*DEVANAGARI_TAGS), text.rlike(DEVANAGARI))
        .when(base == "th", text.rlike(THAI))
        .when(base.isin(*LATIN_TAGS), text.rlike(LATIN))
        .otherwise(text.rlike(r"\p{IsAlphabetic}"))
    )


def residual_script(text: Column, source: Column, target: Column) -> Column:
    """The name of the source's script if a translation still holds it; Latin never counts."""
    src, dst = language(source), language(target)
    family = lambda tags, pattern, name: F.when(src.isin(*tags) & ~dst.isin(*tags) & text.rlike(pattern), name)
    found = F.coalesce(
        family(("ja",), KANA, "kana"),
        family(("ko",), HANGUL, "hangul"),
        F.when((src == "zh") & ~dst.isin("zh", "ja") & text.rlike(CJK), "CJK"),
        family(CYRILLIC_TAGS, CYRILLIC, "Cyrillic"),
        family(ARABIC_TAGS, ARABIC, "Arabic"),
        family(DEVANAGARI_TAGS, DEVANAGARI, "Devanagari"),
        family(("th",), THAI, "Thai"),
    )
    return F.when(src != dst, found)


def identical_requires_translation(text: Column, source: Column, target: Column) -> Column:
    """Whether a copy of the source is wrong as a translation."""
    src, dst = language(source), language(target)
    shared = ((src == "ja") & (dst == "zh")) | ((src == "zh") & (dst == "ja"))
    return (src != dst) & ~(shared & ~text.rlike(KANA)) & needs_translation(text, source)


def machine_literal(text: Column) -> Column:
    """Blank texts, literals, numbers, file names of assets and code: never prose."""
    s = trim(text)
    number = s.rlike(r"(?i)^[+-]?(?:inf(?:inity)?|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)$")
    asset = F.lower(F.substring_index(s, ".", -1)).isin(*ASSET_EXTENSIONS)
    code = s.contains("$game") | s.startswith("function") | s.contains("return ")
    return (s == "") | F.lower(s).isin("true", "false", "null", "undefined") | number | asset | code


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once: inside a lambda an expression is evaluated anew for each element."""
    return F.transform(F.array(value), body)[0]


def latin_residue(translation: Column, source: Column) -> Column:
    """Up to three distinct ASCII words that a translation keeps from its source; short all-capital words may stay."""
    words = F.filter(F.regexp_extract_all(translation, F.lit("[A-Za-z]{2,}"), F.lit(0)), lambda w: ~w.rlike("^[A-Z]{2,4}$"))

    def first(ws: Column, lows: Column, own: Column) -> Column:
        kept = lambda xs: F.filter(xs, lambda x: F.contains(own, x))
        few = lambda xs: F.when(F.size(kept(F.slice(xs, F.lit(1), F.lit(16)))) >= 3, kept(F.slice(xs, F.lit(1), F.lit(16)))).otherwise(kept(xs))
        found = F.slice(let(F.array_distinct(lows), few), 1, 3)
        return F.transform(found, lambda x: F.get(ws, F.array_position(lows, x).cast("int") - 1))

    return let(words, lambda ws: let(F.transform(ws, lambda w: F.lower(w)), lambda lows: let(F.lower(source), lambda own: first(ws, lows, own))))


def line_shape(line: Column) -> Column:
    """The first 160 characters with words as <w> and digit runs as <n>."""
    s = F.left(line, F.lit(160))
    s = F.regexp_replace(s, r"[[\p{IsAlphabetic}\p{N}]&&[^0-9]]+", "\x01")
    return F.replace(F.replace(F.regexp_replace(s, "[0-9]+", "\x02"), F.lit("\x01"), F.lit("<w>")), F.lit("\x02"), F.lit("<n>"))


def display_width(text: Column, control: str = "") -> Column:
    """Cells of a text: one for ASCII, two for anything else, none for what matches control."""
    text = F.regexp_replace(text, control, "") if control else text
    return (2 * F.char_length(text) - F.char_length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))).cast("long")


def natural_key(location: Column) -> Column:
    """A string whose order is that of the location with its digit runs taken as numbers."""
    padded = F.regexp_replace(location, r"(\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, r"(?<!\d)0*(\d{20})(?!\d)", "$1")


def field_of(location: Column) -> Column:
    """The last segment of a location's path that is no number, in lower case."""
    path = F.substring_index(location, "#", -1)
    named = F.filter(F.split(path, "/"), lambda s: ~s.rlike(r"^\+?[0-9]+$") & (s != ""))
    return F.lower(F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit("")))
