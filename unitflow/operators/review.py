"""Flags of units and translations, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitflow.functions import kana, masks, quality, scripts
from unitflow.functions.written import written

SAMPLES = 40


def structure_error(item_type: Column, original: Column, translated: Column) -> Column:
    """The first structural fault of a translation, or null: lines must exist and hold text, arrays keep their lines, short texts have one."""
    blank = lambda x: scripts.trim(x) == ""
    return (
        F.when(F.forall(translated, blank), "translation is empty")
        .when((item_type == "array") & (F.size(original) != F.size(translated)), "line count differs")
        .when((item_type == "array") & F.exists(F.arrays_zip(original.alias("o"), translated.alias("t")), lambda z: blank(z["t"]) & ~blank(z["o"])), "a line is blank")
        .when((item_type == "short_text") & (F.size(translated) != 1), "more than one line")
    )


def with_masks(df: DataFrame, rules: tuple[str, ...] = masks.CORE) -> DataFrame:
    """Adds own and done, the masks of original_lines and lines, and lost and lost_core, the literals that lines lack."""
    df = df.select("*", masks.masked(F.col("original_lines"), rules).alias("own"), masks.masked(F.col("lines"), rules).alias("done"))
    if rules == masks.CORE:
        return df.select("*", masks.lost("lines", F.col("own.literals")).alias("lost")).select("*", F.col("lost").alias("lost_core"))
    df = df.select("*", masks.masked(F.col("original_lines"))["literals"].alias("core"))
    return df.select("*", masks.lost("lines", F.col("own.literals")).alias("lost"), masks.lost("lines", F.col("core")).alias("lost_core")).drop("core")


def label_fault(original: Column, lines: Column, label: str, control: str) -> Column:
    """What is wrong with the speaker of a text whose first line is a label alone, after controls and blanks: the translation begins with one
    too, and has text after it if the source has."""
    lead = rf"(?sU)^((?:(?:{control})|\s)*+)({label})(.*)$"
    mark = lambda x: F.regexp_extract(x, lead, 2)
    ends = lambda m: (F.left(m, F.lit(1)), F.right(m, F.lit(1)), F.substring(m, F.lit(2), F.char_length(m) - 2))

    def shown(x: Column) -> Column:
        """Whether what is matched as a label has text between its two marks, or no marks."""
        first, last, inner = ends(mark(x))
        marked = ~first.rlike(r"[\p{IsAlphabetic}\p{N}]") & ~last.rlike(r"[\p{IsAlphabetic}\p{N}]")
        return (mark(x) != "") & (~marked | ~F.contains(inner, first) & ~F.contains(inner, last) & (scripts.trim(inner) != ""))

    visible = lambda x: scripts.trim(F.regexp_replace(x, control, "")) != ""
    body = lambda xs, rest: visible(rest) | F.exists(F.slice(xs, F.lit(2), F.greatest(F.size(xs), F.lit(1))), visible)
    head, first = F.coalesce(F.get(lines, F.lit(0)), F.lit("")), F.get(original, F.lit(0))
    alone = shown(first) & ~visible(F.regexp_extract(first, lead, 3))
    return F.when(alone, F.when(~shown(head), "speaker missing").when(body(original, F.lit("")) & ~body(lines, F.regexp_extract(head, lead, 3)), "text after the speaker missing"))


def fault(source: Column, target: Column, label: str | None = None, control: str = masks.CONTROL) -> Column:
    """The first fault of a translation, or null. Over with_masks(): item_type, original_lines, lines. What concerns languages is not asked where
    source and target are one."""
    own, done = (F.array_join(F.col(f"{c}.visible"), "\n") for c in ("own", "done"))
    script = scripts.residual_script(done, source, target)
    foreign = F.coalesce(
        label_fault(F.col("original_lines"), F.col("lines"), label, control) if label else F.lit(None).cast("string"),
        F.when((scripts.trim(own) == scripts.trim(done)) & scripts.identical_requires_translation(own, source, target), "same as the source"),
        F.when((scripts.language(target) == "zh") & done.rlike(scripts.KANA), "kana in Chinese"),
        F.when(script.isNotNull(), F.concat(F.lit("source script: "), script)),
    )
    return F.coalesce(
        structure_error(F.col("item_type"), F.col("original_lines"), F.col("lines")),
        F.when((F.col("lost_core") > 0) | (F.col("lost") > 0), "literals lost"),
        masks.literal_fault(F.col("done.literals"), F.col("own.literals")),
        F.when(scripts.language(source) != scripts.language(target), foreign),
    )


BUCKETS = ("residual_source", "kana_edge", "kana_mixed", "kana_untranslated", "identical", "control_loss", "residual_latin")


def inspected(df: DataFrame, source: Column, target: Column, rules: tuple[str, ...] = masks.CORE) -> DataFrame:
    """Adds a boolean for each of BUCKETS and lost. df: original_lines, translation_lines and passthrough (null where there is no translation).

    A unit that was passed through is judged on its source. A copy of a Japanese source counts as untranslated; kana are named before
    other scripts.
    """
    df = df.select("*", F.when(F.col("passthrough"), F.col("original_lines")).otherwise(F.col("translation_lines")).alias("lines"))
    df = with_masks(df, rules)
    own, done, found = F.array_join("own.visible", "\n"), F.array_join("done.visible", "\n"), F.col("passthrough").isNotNull()
    df = df.select("*", own.alias("own_text"), done.alias("done_text"))
    copied = (scripts.trim(F.col("own_text")) == scripts.trim(F.col("done_text"))) & scripts.identical_requires_translation(F.col("own_text"), source, target)
    kind = F.when(copied & (scripts.language(source) == "ja"), "untranslated").otherwise(kana.kana_kind(F.col("done.visible"), target))
    df = df.select("*", (found & copied).alias("identical"), F.when(found, kind).alias("kind"))
    cjk = scripts.language(target).isin("zh", "ja", "ko") & (scripts.language(source) != scripts.language(target))
    latin = cjk & ~F.coalesce("passthrough", F.lit(True)) & (F.size(scripts.latin_residue(F.col("done_text"), F.col("own_text"))) > 0)
    residual = found & (F.col("kind").isNotNull() | scripts.residual_script(F.col("done_text"), source, target).isNotNull())
    kinds = [F.coalesce(F.col("kind") == k, F.lit(False)).alias(f"kana_{k}") for k in kana.KINDS]
    own_names = [c for c in df.columns if c not in ("own", "done", "own_text", "done_text", "kind", "lines")]
    return df.select(*own_names, residual.alias("residual_source"), *kinds, (found & (F.col("lost") > 0)).alias("control_loss"), latin.alias("residual_latin"))


def blocking(df: DataFrame, source: Column, target: Column, rules: tuple[str, ...] = masks.CORE, label: str | None = None) -> DataFrame:
    """The translated units that may not be written: passed through, at fault, or with kana. df: item_type, original_lines, translation_lines, passthrough."""
    own = with_masks(df.where(F.col("passthrough").isNotNull()).withColumn("lines", F.col("translation_lines")), rules)
    bad = F.col("passthrough") | fault(source, target, label).isNotNull() | kana.kana_kind(F.col("done.visible"), target).isNotNull()
    return own.where(bad).select(*df.columns)


def accepted(df: DataFrame, source: Column, target: Column, rules: tuple[str, ...] = masks.CORE, label: str | None = None) -> DataFrame:
    """df with lines and fault: answers with masks restored and normalised, and what is wrong with them, masks first. df: item_type, original_lines, answer."""
    df = df.select("*", masks.masked(F.col("original_lines"), rules).alias("__own"))
    df = df.select("*", masks.mask_fault(F.col("answer"), F.col("__own.literals")).alias("__masks"), masks.unmasked("answer", "__own.literals").alias("__lines"))
    df = df.withColumn("lines", quality.normalised(F.col("__lines"), F.col("item_type"), F.col("original_lines"), F.col("__own.masked"), target, rules))
    df = with_masks(df, rules)
    return df.withColumn("fault", F.coalesce(F.col("__masks"), fault(source, target, label))).drop("__own", "__masks", "__lines", "own", "done", "lost", "lost_core")


def buckets(df: DataFrame, named: dict[str, Column], order: str, *sample: str) -> DataFrame:
    """bucket, n and the first SAMPLES of each in order: a group limit keeps no more than these of a task's rows, so no list of all hits is gathered. Hits are
    written once, as they are read for the counts and for the samples."""
    hits = F.array(*(F.when(test, F.lit(name)) for name, test in named.items()))
    rows = written(df.select(F.explode(F.array_compact(hits)).alias("bucket"), order, *sample), "review-hits")
    w = Window.partitionBy("bucket")
    top = rows.withColumn("rank", F.row_number().over(w.orderBy(order, *sample))).where(F.col("rank") <= SAMPLES)
    samples = top.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("rank", order, *sample))).alias("sample"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n")).join(samples, "bucket")
