"""Scripts, JSON lists, profiles and files on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from unitflow.sources import files, scripts


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("pos").collect()]


def test_ass(spark):
    text = "[Script Info]\nDialogue: 0,no\n[Events]\nFormat: Layer, Start, Name, Text\nComment: 0,1,A,not this\nDialogue: 0,1,Ann,Hello, you\nDialogue: 0,1,Bob,{\\pos(1,2)}\n"
    df = spark.createDataFrame([(1, text), (2, "[Events]\nDialogue: 0,a,b,c,N,0,0,0,,three, parts here"), (3, None)], "file long, text string")
    assert rows(scripts.ass_units(df, F.lit("en"), "text", "file"), "file", "location", "role", "original_lines") == [(2, "L000002", "N", ["three, parts here"]), (1, "L000006", "Ann", ["Hello, you"])]


def test_renpy(spark):
    text = 'label start:\n    e "outside"\ntranslate fr start_1:\n    # e "Hello"\n    e "Hello \\"you\\""\n    voice "a.ogg"\ntranslate fr strings:\n    old "Start game"\n    new ""\n'
    df = spark.createDataFrame([(1, text)], "file long, text string")
    assert rows(scripts.renpy_units(df, F.lit("en"), "text", "file"), "domain", "location", "original_lines") == [("dialogue", "n000005", ['Hello "you"']), ("strings", "n000009", ["Start game"])]


def test_json_lists(spark):
    made = {"mtool": {"some text": "", "12": ""}, "paratranz": [{"key": "a", "original": "some text"}, {"key": "b", "original": "done text", "translation": "x"}], "vnt": [{"name": "Ann", "message": "some text"}, {"message": "12"}]}
    for kind, value in made.items():
        df = spark.createDataFrame([(1, json.dumps(value)), (2, "no json")], "file long, text string")
        got = rows(scripts.json_list_units(df, F.lit("en"), kind, "text", "file"), "pos", "role", "original_lines")
        assert got == [(0, "Ann" if kind == "vnt" else "", ["some text"])]
    with pytest.raises(ValueError):
        scripts.json_list_units(df, F.lit("en"), "other")


def test_profile(spark):
    df = spark.createDataFrame([(1, "// skip this\nAnn: hello there\nplain words\n")], "file long, text string")
    rules = [(r"^(\w+): (.*)$", 2, 1), (r"^(.*)$", 1, 0)]
    assert rows(scripts.profile_units(df, F.lit("en"), rules, ["^//"], "custom", "text", "file"), "pos", "role", "original_lines") == [(2, "Ann", ["hello there"]), (3, "", ["plain words"])]
    with pytest.raises(ValueError):
        scripts.profile_units(df, F.lit("en"), [(r"(?<=a)b", 0, 0)], [])


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("﻿one line\n".encode())
    (tmp_path / "sub/b.txt").write_bytes("日本語のテキスト".encode("shift_jis"))
    (tmp_path / "sub/c.txt").write_bytes(b"\xff\xfe" + "wide text".encode("utf-16-le"))
    (tmp_path / ".hidden.txt").write_text("hidden text")
    (tmp_path / "t.tsv").write_text("id\tsome cell\n")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.encoding) for r in files.texts(spark, str(tmp_path), "*.txt").collect()}
    assert got == {"a.txt": ("one line\n", "utf-8"), "b.txt": ("日本語のテキスト", "shift_jis"), "c.txt": ("wide text", "utf-16-le")}
    assert sorted(r.original_lines[0] for r in files.read_units(spark, str(tmp_path), "en", "txt").collect()) == ["one line", "wide text"]
    assert [r.location for r in files.read_units(spark, str(tmp_path), "en", "tsv").collect()] == ["r000000/1"]
    assert files.formats(spark).count() == len(files.READERS)
    with pytest.raises(ValueError):
        files.read_units(spark, str(tmp_path), "en", "nothing")
