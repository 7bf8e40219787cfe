"""Quality rules: base counts of words, symbols and repetition, and the divergence of a text's histograms.

Two histograms describe a text: its characters by class, and how often it uses common words of its language.
Each is compared with the reference of the language, summed over all documents of that language, by the
Jensen-Shannon distance. Texts shorter than a guard are not judged by it. DataFrame functions only.

A null text has no words and fails the base rule. A language without a list of common words, or a null one,
is compared with the reference of all such documents by its characters alone. Rows that repeat are judged each; ids may be null;
an empty table gives an empty result. Texts of any length are judged whole; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.llm.shared import SPACE, materialize

#: Frequent function words of each language, most of them found in any text of some length.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was with as be this by at are an or from".split(),
    "fr": "le la de et un une les des en que dans pour qui sur par au pas ne avec est du ce".split(),
    "de": "der die das und ist von zu den mit ein eine auf für im nicht sich des dem als es auch an".split(),
    "es": "el la de que y en un una los las por con no se del para es su al lo como más".split(),
}
N_COMMON = 22
CLASSES = ("lower", "space", "upper", "letter", "digit", "point", "rest")
#: Words from which a text is judged by its characters, and by its common words: shorter histograms are too sparse.
MIN_WORDS = 50
MIN_WORDS_FOR_WORDS = 100
#: Words from which a language's reference judges documents.
MIN_REFERENCE_WORDS = 1000
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.30
WINDOW = 5


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays that each sum to 1."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _share(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts and both histograms of each document, without its text."""
    lang = F.col(lang_col).cast("string")
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.when(lang.isin(*COMMON_WORDS), lang).otherwise("other").alias("language"))
    df = df.select("*", F.array_remove(F.split("text", SPACE), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    df = df.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), F.size("words").cast("long").alias("n_words"))
    window = F.transform("h", lambda x, i: F.xxhash64(x, *(F.get(F.col("h"), i + k) for k in range(1, WINDOW))))
    df = df.select("*", F.slice(window, F.lit(1), F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0))).alias("wins"))
    # Most texts repeat no window: only the others sort theirs to find the places.
    df = df.select("*", F.when(F.size(F.array_distinct("wins")) < F.size("wins"), F.sort_array(F.transform("wins", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("sorted"))
    same = lambda x, y: F.coalesce(x["x"] == y["x"], F.lit(False))
    twice = F.filter("sorted", lambda x, k: same(x, F.get(F.col("sorted"), k - 1)) | same(x, F.get(F.col("sorted"), k + 1)))
    df = df.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("places"))
    covered = F.aggregate("places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")))["n"]
    df = df.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    rest, lengths = F.col("text"), []
    for name, pattern in zip(CLASSES, (r"[a-z]+", SPACE, r"[A-Z]+", r"\p{L}+", r"[0-9]+", r"[.,;:'\"?()-]+"), strict=False):
        df = df.select("*", F.regexp_replace(rest, pattern, "").alias(f"no_{name}"))
        lengths.append((F.char_length(rest) - F.char_length(F.col(f"no_{name}"))).cast("long"))
        rest = F.col(f"no_{name}")
    lengths.append(F.char_length(rest).cast("long"))
    lists = F.coalesce(*(F.when(F.col("language") == k, F.array(*map(F.lit, v))) for k, v in COMMON_WORDS.items()), F.array().cast("array<string>"))
    df = df.select("*", lists.alias("common"))
    df = df.select("*", F.array_remove(F.transform("words", lambda w: F.array_position(F.col("common"), F.lower(w))), 0).alias("hits"))
    uses = F.array(*((F.size("hits") - F.size(F.array_remove("hits", k + 1))).cast("long") for k in range(N_COMMON)), (F.col("n_words") - F.size("hits")).cast("long"))
    return df.select(
        "doc_id", "language", "n_words",
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", F.array(*lengths).alias("class_counts"), uses.alias("word_counts"),
    )


def references(feats: DataFrame) -> DataFrame:
    """The summed histograms of each language: a row for each language of COMMON_WORDS, and one for the others."""
    total = lambda c, n: F.array(*(F.sum(F.col(c)[k]) for k in range(n)))
    sums = feats.groupBy("language").agg(total("class_counts", len(CLASSES)).alias("all_classes"), total("word_counts", N_COMMON + 1).alias("all_words"), F.sum("n_words").alias("reference_words"))
    return sums.select("language", _share(F.col("all_classes")).alias("class_reference"), _share(F.col("all_words")).alias("word_reference"), "reference_words")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS, min_words_for_words: int = MIN_WORDS_FOR_WORDS, max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, min_reference_words: int = MIN_REFERENCE_WORDS, reference: DataFrame | None = None) -> DataFrame:
    """One row per document: base counts, base_failed, class_distance, word_distance and kept.

    The references are those of the documents of reference, or of all documents judged. A language whose reference has fewer words than
    min_reference_words judges none: such a reference says little, and two or three texts would judge themselves.

    The features, which hold no text, are written once: the references and the verdicts both read them. The
    references are at most five rows, so they are broadcast.
    """
    feats = materialize(features(docs, id_col, text_col, lang_col), "quality")
    own = feats if reference is None else features(reference, id_col, text_col, lang_col)
    df = feats.join(F.broadcast(references(own)), "language", "left")
    df = df.select("*", _share(F.col("class_counts")).alias("p"), _share(F.col("word_counts")).alias("q"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = df.select("*", failed.alias("base_failed"), _distance(F.col("p"), F.col("class_reference")).alias("class_distance"), _distance(F.col("q"), F.col("word_reference")).alias("word_distance"))
    sparse = lambda n: (F.col("n_words") < n) | (F.coalesce("reference_words", F.lit(0)) < min_reference_words)
    close = (sparse(min_words) | (F.col("class_distance") <= max_class_distance)) & (sparse(min_words_for_words) | (F.col("word_distance") <= max_word_distance))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & close).alias("kept"))
