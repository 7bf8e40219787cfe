"""Nested JSON there and back, encodings of labelled samples, and profiles."""

import json
import random

import pytest
from pyspark.sql import functions as F

from unitflow.operators import profiles
from unitflow.plans import engine
from unitflow.sources import encodings, files, nested

SAMPLES = {
    "shift_jis": ["吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。", "ゲームを始めますか？", "メッセージ"],
    "euc_jp": ["吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。", "ゲームを始めますか？", "これは文章です"],
    "gb18030": ["我们的生活越来越好，大家都很高兴。", "游戏开始了，请选择你的角色。", "今天天气很好"],
    "big5": ["我們的生活越來越好，大家都很高興。", "遊戲開始了，請選擇你的角色。", "今天天氣很好"],
    "euc_kr": ["우리는 오늘 학교에 갔습니다. 날씨가 좋았어요.", "게임을 시작하시겠습니까?", "안녕하세요"],
    "cp1252": ["Où est le café ? Il a été fermé à cinq heures.", "Die Straße führt über die Brücke.", "El niño comió una manzana mañana"],
}


@pytest.mark.parametrize("name", SAMPLES)
def test_labelled_samples(name):
    for text in SAMPLES[name]:
        assert files.decoded(text.encode(name)) == (text, name)
        assert files.decoded((text + " and some English words. ").encode(name) * 50) == ((text + " and some English words. ") * 50, name)


def test_marks_and_binary():
    assert files.decoded("é".encode()) == ("é", "utf-8") and files.decoded(b"\xff\xfea\0") == ("a", "utf-16-le")
    assert files.decoded(b"\x89PNG\0\xff")[1] == "binary" and encodings.legacy(b"") == ("", "shift_jis")


LINE = 'He said "hi" \\ there\nand é 漢'


def deep(text, levels, **style):
    value = {"id": "skip this one", "list": [1, None, {"text": text, "n": 2}]}
    for _ in range(levels):
        value = {"text": text, "more": json.dumps(value, **style)}
    return json.dumps(value, **style)


@pytest.mark.parametrize("style", [{}, {"ensure_ascii": False}, {"separators": (",", ":")}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_levels_there_and_back(style):
    text = deep(LINE, 3, **style)
    found = dict(nested.leaves(text))
    assert sum(v == LINE for v in found.values()) == 4 and "!/more!/more!/more!/list/2/text" in found
    assert nested.with_texts(text, found) == text and nested.with_texts(text, {}) == text
    put = {k: f"«{v}»" for k, v in found.items() if v == LINE}
    assert nested.with_texts(text, put) == deep(f"«{LINE}»", 3, **style)


def test_what_is_not_opened_and_refusals():
    assert dict(nested.leaves('{"a": "12", "b": "true", "c": "{broken", "d": "\\"quoted\\"", "x/y": "z", "e": "[1]"}')) == {"!/a": "12", "!/b": "true", "!/c": "{broken", "!/d!": "quoted"}
    for bad in ({"!/q": "x"}, {"!/e!/0": "x"}, {"!/e!/7": "x"}, {"!/a!": "x"}, {"!/a/b": "x"}, {"!/a": "x", "!/a/b": "y"}):
        with pytest.raises(ValueError):
            nested.with_texts('{"a": "12", "e": "[1]"}', bad)
    assert nested.with_texts('"' * 3, {}) == '"' * 3 and dict(nested.leaves("plain")) == {"": "plain"}


def test_random_trees():
    rng = random.Random(3)

    def tree(depth):
        kind = rng.choice(["text", "list", "dict", "string", "number"]) if depth else "text"
        if kind == "list":
            return [tree(depth - 1) for _ in range(rng.randint(0, 3))]
        if kind == "dict":
            return {f"k{k}": tree(depth - 1) for k in range(rng.randint(0, 3))}
        if kind == "string":
            return json.dumps(tree(depth - 1), separators=(",", ":"))
        return rng.choice([1, None, True]) if kind == "number" else rng.choice(["Hello", 'a "b"', "x\ny", ""])

    for _ in range(400):
        text = json.dumps(tree(6), separators=(",", ":"))
        found = dict(nested.leaves(text))
        assert nested.with_texts(text, found) == text
        again = nested.with_texts(text, {k: f"<{v}>" for k, v in found.items()})
        assert dict(nested.leaves(again)) == {k: f"<{v}>" for k, v in found.items()}


def test_refused_files_stay(spark):
    df = spark.createDataFrame([(1, deep(LINE, 2)), (2, deep(LINE, 2)), (3, "no JSON"), (4, None)], "file int, text string")
    plain = spark.createDataFrame([(1, deep("Hello there friend", 2))], "file int, text string")
    own = nested.nested_units(plain, F.lit("en"), "text", "file")
    assert {(r.location, r.original_lines[0]) for r in own.collect()} == {(p, "Hello there friend") for p in ("!/text", "!/more!/text", "!/more!/more!/list/2/text")}
    done = spark.createDataFrame([(1, "!/text", "new"), (2, "!/nowhere", "new"), (2, "!/text", "new")], "file int, location string, translation string")
    got = {r.file: (r.text, r.reason) for r in nested.written_back(df, done, "file").collect()}
    assert json.loads(got[1][0])["text"] == "new" and got[2] == (deep(LINE, 2), "no such place: nowhere") and got[3] == ("no JSON", None)


def test_profiles(spark):
    rows = [("a.txt", 1, "  Indented line of text\nAnother line here\n"), ("b.txt", 2, "Key words stand here\n")]
    df = spark.createDataFrame(rows, "path string, doc_id long, text string")
    sound, lossy = engine.line_profile("sound", ("Indented", "Key words")), engine.line_profile("lossy", (), False)
    late = df.withColumn("text", F.concat(F.repeat(F.lit("x"), 1 << 16), "text"))
    assert profiles.detected(df, [sound, lossy], F.lit("en")) == ["sound", "lossy"]
    assert profiles.detected(late, [sound], F.lit("en")) == [] and profiles.detected(df.limit(0), [sound], F.lit("en")) == []
    assert profiles.detected(df.unionByName(spark.createDataFrame([("c.bin", 3, "x")], df.schema)), [sound, lossy], F.lit("en")) == []
    assert profiles.validated(df, sound, F.lit("en")).collect() == []
    assert {(r.path, r.fault) for r in profiles.validated(df, lossy, F.lit("en")).collect()} >= {("a.txt", "a write without translations changes it")}
    assert tuple(profiles.coverage(df, sound.reader(df, F.lit("en"))).first()) == (2, 2)
