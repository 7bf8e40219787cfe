"""Checks and normalisation of translations on small inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from unitflow.functions import masks, quality
from unitflow.operators import review


def first(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("actual", "expected", "fault"),
    [
        (["{a}", "%d"], ["%d", "{a}"], None),
        (["\\C[1]", "%d"], ["%d", "\\C[1]"], "literals out of order"),
        (["%d", "%d"], ["%d"], "unexpected literal"),
        (["%d"], ["%d", "{a}"], "missing literal"),
        (["%2$s", "%1$s"], ["%1$s", "%2$s"], None),
        ([], [], None),
    ],
)
def test_literal_fault(spark, actual, expected, fault):
    assert first(spark, "a array<string>, e array<string>", (actual, expected), masks.literal_fault(F.col("a"), F.col("e"))) == fault


@pytest.mark.parametrize(
    ("lines", "fault"),
    [
        (["[CTRL_1] x [CTRL_0]", "[CTRL_2]"], None),
        (["[CTRL_0] [CTRL_2] [CTRL_1]"], None),
        (["[CTRL_2] [CTRL_0]"], "missing mask"),
        (["[CTRL_0] [CTRL_0]"], "mask twice"),
        (["[CTRL_9]"], "unknown mask"),
        (["[CTRL_00]"], "unknown mask"),
    ],
)
def test_mask_fault(spark, lines, fault):
    assert first(spark, "a array<string>, e array<string>", (lines, ["\\C[1]", "{name}", "{x}"]), masks.mask_fault(F.col("a"), F.col("e"))) == fault
    reverse = first(spark, "a array<string>, e array<string>", (["[CTRL_1] [CTRL_0]"], ["\\C[1]", "%d"]), masks.mask_fault(F.col("a"), F.col("e")))
    assert reverse == "masks out of order"


@pytest.mark.parametrize(
    ("lines", "kind", "out"),
    [
        (["Hello\nworld"], "short_text", ["Hello world"]),
        (["你好\r\n世界"], "short_text", ["你好世界"]),
        (["a \nb\n c"], "short_text", ["a b c"]),
        (["你\n\n好"], "short_text", ["你 好"]),
        (["a\nb", "", " "], "long_text", ["a", "b"]),
        (["a", ""], "array", ["a", ""]),
        (["", " "], "long_text", ["", " "]),
        (["x\ry"], "array", ["x", "y"]),
    ],
)
def test_sanitised(spark, lines, kind, out):
    assert first(spark, "a array<string>, k string", (lines, kind), quality.sanitised(F.col("a"), F.col("k"))) == out


def test_restored(spark):
    original = ["\\C[1] {a}", "text", "%d x"]
    df = spark.createDataFrame([(["", "", ""], original), (["", ""], original), (["kept", "t", ""], original)], "a array<string>, o array<string>")
    out = df.select(quality.restored(F.col("a"), F.col("o"), masks.masked(F.col("o"))["masked"]).alias("x")).collect()
    assert [r.x for r in out] == [["\\C[1] {a}", "", ""], ["", ""], ["kept", "t", ""]]


@pytest.mark.parametrize(
    ("line", "out"),
    [
        ("你们好っ", "你们好"),
        ("你们好っす", "你们好哦"),
        ("你们好っすよー", "你们好哦～"),
        ("你们好です", "你们好です"),
        ("你们说「すごい」っ", "你们说「すごい」"),
        ("\\C[1]你们っ\\N[2]好", "\\C[1]你们\\N[2]好"),
        ("東京っ", "東京っ"),
        ("plain", "plain"),
    ],
)
def test_sounds(line, out):
    assert quality.without_sounds(line) == out
    assert quality.without_sounds(out) == out


def test_lost_tokens_by_brute_force():
    """An alternation of the literals, longest first, against a scan that claims the longest literal at each place."""
    rng = random.Random(3)
    for _ in range(500):
        literals = ["".join(rng.choices("ab{", k=rng.randint(1, 3))) for _ in range(rng.randint(0, 5))]
        lines = ["".join(rng.choices("ab{", k=rng.randint(0, 8))) for _ in range(2)]
        text, left, at = "\n".join(lines), list(literals), 0
        while at < len(text):
            here = max((x for x in set(literals) if text.startswith(x, at)), key=len, default=None)
            if here in left:
                left.remove(here)
            at += len(here) if here else 1
        assert masks.lost_tokens(lines, literals) == len(left)


def test_label_fault(spark):
    own = ["\\C[1]【Ann】", "some words"]
    rows = [(["【安】", "话"],), (["话"],), (["【安】"],), (["【安】 话"],), (["【 】", "话"],)]
    df = spark.createDataFrame([(own, r[0]) for r in rows], "o array<string>, l array<string>")
    got = [r.x for r in df.select(review.label_fault(F.col("o"), F.col("l"), "【[^】]*】", masks.CONTROL).alias("x")).collect()]
    assert got == [None, "speaker missing", "text after the speaker missing", None, "speaker missing"]
    free = spark.createDataFrame([(["plain words", "x"], ["话"])], "o array<string>, l array<string>")
    assert free.select(review.label_fault(F.col("o"), F.col("l"), "【[^】]*】", masks.CONTROL).alias("x")).first().x is None


def test_accepted(spark):
    rows = [(["\\C[1]Hello {name}"], ["[CTRL_1] [CTRL_0]你好"], None), (["\\C[1]Hello"], ["你好"], "missing mask"), (["Hello there"], ["Hello there"], "same as the source"), (["Hello"], [" "], "translation is empty"), (["Hello"], None, "translation is empty")]
    df = spark.createDataFrame([(i, "short_text", o, a) for i, (o, a, _) in enumerate(rows[:4])], "i long, item_type string, original_lines array<string>, answer array<string>")
    got = {r.i: (r.fault, r.lines) for r in review.accepted(df, F.lit("en"), F.lit("zh")).collect()}
    assert [got[i][0] for i in range(4)] == [f for _, _, f in rows[:4]]
    assert got[0][1] == ["{name} \\C[1]你好"] and re.fullmatch(r"\s*", got[3][1][0])


def test_lines_without_literals_need_no_worker(spark):
    rows = spark.createDataFrame([(1, ["plain", "text"]), (2, ["50%% \\C[1]", "x"]), (3, None), (4, [])], "k int, x array<string>")
    out = {r.k: r.m for r in rows.select("k", masks.masked(F.col("x")).alias("m")).collect()}
    assert out[1].masked == out[1].visible == ["plain", "text"] and out[1].literals == []
    assert out[2].literals == ["%%", "\\C[1]"] and out[2].masked == ["50[CTRL_0] [CTRL_1]", "x"]
    assert out[4].literals == [] and (out[3] is None or out[3].masked is None)


def test_breaks_go_as_before(spark):
    cases = ["你\n好", "a\nb", "a \nb", "a\n b", "a\n\nb", "a\n\n b", "\n b", "a \n\n\nb", "你\n\n好", "\na", "a\n"]
    old = F.regexp_replace(F.regexp_replace(F.col("s"), rf"(?<={quality.WIDE})\n(?={quality.WIDE})", ""), rf"(?U)(?<={quality.BLANK})\n+|(?<![\n])\n(?={quality.BLANK})", "")
    df = spark.createDataFrame([(c,) for c in cases], "s string").select(quality.joined(F.col("s")).alias("a"), F.regexp_replace(old, r"\n+", " ").alias("b"))
    assert all(r.a == r.b for r in df.collect())
