"""A folder of many formats in one read."""

import json

import pytest
from pyspark.sql import functions as F

from unitflow.operators import profiles
from unitflow.sources import files, folders

MESSAGE = {"events": [None, {"id": 2, "pages": [{"list": [{"code": 101, "parameters": ["", 0, 0, 2, "Ann"]}, {"code": 401, "parameters": ["Hello from the game"]}]}]}]}
FILES = {
    "a/plain.txt": "First line of text\n\nSecond line of text\n",
    "a/notes.md": "# A heading here\n\n```\ncode line\n```\n",
    "a/one.srt": "1\n00:00:01,000 --> 00:00:02,000\nHello subtitle\n",
    "a/two.vtt": "WEBVTT\n\n00:01.000 --> 00:02.000\nHello again\n",
    "b/words.csv": "key,text\nk1,Hello table cell\n",
    "b/list.po": 'msgid "Hello catalogue"\nmsgstr ""\n',
    "b/page.HTM": "<html><body><p>Hello page</p></body></html>",
    "b/settings.ini": "; note\n[shop]\ntitle = Welcome to the shop\n",
    "b/data.xml": "<a><b>Hello from markup</b></a>",
    "b/lines.jsonl": '{"id": "x", "text": "Hello record"}\n',
    "j/paratranz.json": json.dumps([{"key": "k", "original": "Hello original", "translation": ""}]),
    "j/vnt.json": json.dumps([{"name": "Ann", "message": "Hello message"}]),
    "j/mtool.json": json.dumps({"Hello tool": "Hello tool"}),
    "j/i18next.json": json.dumps({"menu": {"title": "Hello menu", "more": "Hello more"}}),
    "j/other.json": json.dumps({"title": "Hello tree", "n": [1, 2, 3]}),
    "game/data/System.json": json.dumps({"gameTitle": "A great game", "terms": {}}),
    "game/data/Map001.json": json.dumps(MESSAGE),
    "game/data/extra.json": json.dumps({"menu": {"title": "Hello beside the game", "x": "And more"}}),
    "lone/System.json": json.dumps({"gameTitle": "No game at all", "n": 5, "m": 6}),
    "code.py": "import this\n\ndef f():\n    return 1\n",
    "empty.txt": "",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("mixed")
    for name, text in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(text.encode())
    (top / "sjis.txt").write_bytes("こんにちは Hello world\n".encode("shift_jis"))
    (top / "image.png").write_bytes(b"\x89PNG\0\0\xff\xfe")
    (top / ".hidden.txt").write_bytes(b"Hidden text here")
    return str(top)


ENGINES = {
    "a/plain.txt": "txt", "a/notes.md": "md", "a/one.srt": "srt", "a/two.vtt": "srt", "b/words.csv": "csv", "b/list.po": "po", "b/page.HTM": "html", "b/settings.ini": "auto", "b/data.xml": "auto", "b/lines.jsonl": "jsonl",
    "j/paratranz.json": "paratranz", "j/vnt.json": "vnt", "j/mtool.json": "mtool", "j/i18next.json": "i18next", "j/other.json": "auto", "game/data/System.json": "rmmz", "game/data/Map001.json": "rmmz", "game/data/extra.json": "i18next",
    "lone/System.json": "auto", "code.py": "none", "sjis.txt": "txt", "image.png": "none",
}


def test_claims_and_units(spark, folder):
    claims = folders.claimed(folders.binary_files(spark, folder))
    rel = lambda p: p.split(folder, 1)[1].lstrip("/")
    assert {rel(r.path): r.engine for r in claims.collect()} == ENGINES
    units = folders.units_of(claims, "en")
    assert tuple(units.columns) == folders.COLUMNS
    got = {(rel(r.path), "\n".join(r.original_lines)) for r in units.collect()}
    assert got == {
        ("a/plain.txt", "First line of text"), ("a/plain.txt", "Second line of text"), ("a/notes.md", "A heading here"), ("a/one.srt", "Hello subtitle"), ("a/two.vtt", "Hello again"), ("b/words.csv", "key"), ("b/words.csv", "text"), ("b/words.csv", "Hello table cell"),
        ("b/list.po", "Hello catalogue"), ("b/page.HTM", "Hello page"), ("b/settings.ini", "Welcome to the shop"), ("b/data.xml", "Hello from markup"), ("b/lines.jsonl", "Hello record"), ("j/paratranz.json", "Hello original"), ("j/vnt.json", "Hello message"),
        ("j/mtool.json", "Hello tool"), ("j/i18next.json", "Hello menu"), ("j/i18next.json", "Hello more"), ("j/other.json", "Hello tree"), ("game/data/System.json", "A great game"), ("game/data/Map001.json", "Hello from the game"), ("game/data/Map001.json", "Ann"),
        ("game/data/extra.json", "Hello beside the game"), ("game/data/extra.json", "And more"), ("lone/System.json", "No game at all"), ("sjis.txt", "こんにちは Hello world"),
    }
    seen = {r.engine: (r.files, r.files_with_units, r.units) for r in folders.coverage(claims, units).collect()}
    assert seen["none"] == (2, 0, 0) and seen["txt"] == (2, 2, 3) and seen["rmmz"] == (2, 2, 3)


def test_a_format_reads_its_own_files_alone(spark, folder):
    claims = folders.claimed(folders.binary_files(spark, folder))
    one = folders.units_of(claims, "en", "srt")
    assert {r.original_lines[0] for r in one.collect()} == {"Hello subtitle", "Hello again"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(engine" in plan and "content" not in plan.split("ReadSchema: ")[1].split("\n")[0]
    direct = files.read_units(spark, f"{folder}/a", "en", "txt").select("id").collect()
    assert sorted(direct) == sorted(folders.units_of(claims, "en", "txt").where(F.col("path").contains("/a/")).select("id").collect())
    assert folders.read_folder(spark, folder, "en", "nothing").collect() == []


def test_digests_of_lists_tell_them_apart(spark):
    """What a profile's trial compares in place of texts."""
    rows = [(["a", "b"],), (["a,b"],), ([None, "a"],), (["a"],), (["-"],), ([None],), ([],), ([""],), (None,)]
    got = [r.d for r in spark.createDataFrame(rows, "x array<string>").select(profiles._digest(F.col("x")).alias("d")).collect()]
    assert len(set(got)) == len(rows) and got[-1] is None
