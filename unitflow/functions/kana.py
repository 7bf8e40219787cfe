"""Kana left in a translation, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from unitflow.functions.scripts import CJK, KANA, language, let

# Characters and words that only Chinese uses, particles of Japanese grammar, quotation marks.
CHINESE_CHARACTERS = "这這吗嗎么麼你妳们們唔呜嗚咯哟喲哦呀啊咱啥哪没沒请热说话让别还对现怀爷译该难觉实爱开"
CHINESE_WORDS = "小心|舒服|羞耻|羞恥|不要|不行|务必|務必|字形|今天|现在|現在|谢谢|謝謝"
PARTICLES = ("の", "は", "を", "が", "に", "で", "と", "も", "へ")
QUOTES = "「[^「」\\r\\n]*」|『[^『』\\r\\n]*』|“[^“”\\r\\n]*”|‘[^‘’\\r\\n]*’|\"[^\"\\r\\n]*\"|'[^'\\r\\n]*'|`[^`\\r\\n]*`"
MECHANICAL = "^(?:っすよ|っす|[っッー])++$"
HANGUL_OR_ASCII = r"[A-Za-z\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]"
KINDS = ("edge", "mixed", "untranslated")


def chinese_context(text: Column) -> Column:
    """Whether a text is Chinese by its characters and words, and has no more kana than Han characters besides sounds that
    translators leave in by rote."""
    han = F.char_length(text) - F.char_length(F.regexp_replace(text, CJK, ""))
    runs = F.regexp_extract_all(text, F.lit(f"{KANA}+"), F.lit(0))
    strong = text.rlike(f"[{CHINESE_CHARACTERS}]")
    evidence = strong | text.rlike(CHINESE_WORDS) | ((han >= 2) & text.rlike("[了的]"))
    other = F.aggregate(F.filter(runs, lambda r: ~r.rlike(MECHANICAL)), F.lit(0), lambda n, r: n + F.char_length(r))
    return (han > 0) & evidence & (han >= other) & (strong | ~F.exists(runs, lambda r: r.isin(*PARTICLES)))


def line_kind(line: Column, target: Column) -> Column:
    """edge, mixed or untranslated for a line with kana, or null."""
    runs = F.regexp_extract_all(line, F.lit(f"{KANA}+"), F.lit(0))
    quoted = F.exists(F.regexp_extract_all(line, F.lit(QUOTES), F.lit(0)), lambda q: q.rlike(KANA) & ~chinese_context(q))
    edge = ~quoted & F.forall(runs, lambda r: r.rlike("^[っッー]+$"))
    chinese = F.when(~chinese_context(line), "untranslated").when(edge, "edge").otherwise("mixed")
    other = F.when(line.rlike(HANGUL_OR_ASCII), "mixed").otherwise("untranslated")
    return F.when((target != "ja") & line.rlike(KANA), F.when(target == "zh", chinese).otherwise(other))


def kana_kind(lines: Column, target: Column) -> Column:
    """The worst kind of a unit's lines, or null; nothing is amiss in a Japanese target."""
    kinds = F.transform(lines, lambda x: line_kind(x, language(target)))
    return let(kinds, lambda found: F.coalesce(*(F.when(F.array_contains(found, k), k) for k in reversed(KINDS))))
