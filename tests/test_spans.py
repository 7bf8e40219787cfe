"""Spans of files without a declared format, and edits in their places."""

import json

import pytest
from pyspark.sql import functions as F

from unitflow.sources import spans

JSON_TEXT = '{"title": "Hello brave traveler", "id": "Hello there friend", "nested": {"url": "a b c", "lines": ["One \\u00e9 line", "\\"Two\\"", 3]},\r\n "n": null}'
XML_TEXT = '<?xml version="1.0"?><a><!-- Not this text --><b k="v">Hello brave traveler &amp; friends</b> <c/>\n  Loose é words  </a>'
INI_TEXT = "; note\n[shop]\ntitle = Welcome to the shop ; note\nquoted = \"Hello # there\" # note\npath = some file name\nempty =\n"
TOML_TEXT = "[menu]\ntitle = \"Hello brave traveler\"\ncount = 3\nother = 'It is here'\n"
YAML_TEXT = "menu:\n  title: Hello brave traveler # note\n  single: 'It''s a fine day'\n  path:\n    under: Hello there friend\nlast: \"Quoted é text\"\n"
PROSE_TEXT = "This is a longer paragraph of plain prose.\n\n  And another sentence stands in this line, too.\n"


@pytest.mark.parametrize("text, name, kind", [(JSON_TEXT, "x", "json"), (XML_TEXT, "x", "xml"), (INI_TEXT, "x", "ini"), (INI_TEXT, "x.ini", "ini"), (TOML_TEXT, "x", "toml"), (YAML_TEXT, "x", "yaml"), (PROSE_TEXT, "x", "prose")])
def test_spans_hold_their_texts(text, name, kind):
    found, own = spans.scan(text, name)
    data = text.encode()
    assert found == kind and own
    for start, end, style, _, value in own:
        raw = data[start:end].decode()
        if style in ("json", "double"):
            assert json.loads(raw) == value
        elif style.startswith("single"):
            assert raw[1:-1].replace("''", "'") == value
        elif style in ("bare_ini", "bare_yaml", "prose"):
            assert raw == value
        else:
            assert raw.replace("&amp;", "&") == value


@pytest.mark.parametrize("text", ["", None, "\0Hello brave traveler", "fn main() { println!(\"Hello world\"); }", "const text = \"Hello traveler\";", "message: |\n  This is a longer prose paragraph.\n", "message: &anchor Hello traveler\n", "[broken json containing English words",
    "a,b,c\nd,e,f\n", "<a><b></a>", "{\"a\": NaN}", "Short line", "<!DOCTYPE a [<!ENTITY x \"Hello there\">]><a>&x;</a>", "[" * 200 + "]" * 200])
def test_what_no_scanner_takes(text):
    assert spans.scan(text)[0] is None


def test_paths_and_people(spark):
    files = spark.createDataFrame([("a.json", JSON_TEXT), ("b.xml", XML_TEXT), ("c.ini", INI_TEXT), ("d.toml", TOML_TEXT), ("e.yml", YAML_TEXT), ("f.txt", PROSE_TEXT), ("g.bin", "\0"), ("h", None)], "file string, text string")
    got = {(r.file, r.path, r.text) for r in spans.spans(files).where(spans.for_people()).collect()}
    assert got == {
        ("a.json", "title", "Hello brave traveler"), ("a.json", "nested/lines/0", "One é line"), ("a.json", "nested/lines/1", '"Two"'),
        ("b.xml", "a/b", "Hello brave traveler & friends"), ("b.xml", "a", "Loose é words"),
        ("c.ini", "shop/title", "Welcome to the shop"), ("c.ini", "shop/quoted", "Hello # there"),
        ("d.toml", "menu/title", "Hello brave traveler"), ("d.toml", "menu/other", "It is here"),
        ("e.yml", "menu/title", "Hello brave traveler"), ("e.yml", "menu/single", "It's a fine day"), ("e.yml", "last", "Quoted é text"),
        ("f.txt", "", "This is a longer paragraph of plain prose."), ("f.txt", "", "And another sentence stands in this line, too."),
    }
    assert {r.format: (r.files, r.spans) for r in spans.coverage(files).collect()}[None] == (2, 0)


FILES = [("a.json", JSON_TEXT), ("b.xml", XML_TEXT), ("c.ini", INI_TEXT), ("d.toml", TOML_TEXT), ("e.yml", YAML_TEXT), ("f.txt", PROSE_TEXT), ("g.bin", "\0 x")]


def edits_of(files, translation):
    own = spans.span_units(files, F.lit("en"))
    return own.select("file", "hash", "start", "end", "style", translation(F.col("original_lines")[0]).alias("translation"))


def test_no_edits_and_same_edits_are_byte_exact(spark):
    files = spark.createDataFrame(FILES, "file string, text string")
    none = edits_of(files, lambda x: x).limit(0)
    assert {(r.file, r.text, r.reason) for r in spans.edited(files, none).collect()} == {(a, b, None) for a, b in FILES}
    plain = [f for f in FILES if f[0] != "a.json"]  # an escaped é is written as it is
    got = spans.edited(files, edits_of(files, lambda x: x)).collect()
    yaml = YAML_TEXT.replace("title: Hello brave traveler #", 'title: "Hello brave traveler" #')  # bare values are quoted
    assert {(r.file, r.text, r.reason) for r in got} >= {(a, yaml if a == "e.yml" else b, None) for a, b in plain}


def test_edits_there_and_back(spark):
    files = spark.createDataFrame(FILES, "file string, text string")
    put = lambda x: F.concat(F.lit('«é" \' # & ; '), x, F.lit(" 漢»"))
    out = {r.file: r for r in spans.edited(files, edits_of(files, put)).collect()}
    assert out["f.txt"].reason == "the structure has changed" and out["f.txt"].text == PROSE_TEXT  # ; and # are no prose
    changed = spark.createDataFrame([(f, r.text) for f, r in out.items()], "file string, text string")
    for f in ("a.json", "b.xml", "c.ini", "d.toml", "e.yml"):
        assert out[f].reason is None and out[f].text != dict(FILES)[f]
    was = {(r.file, r.nth): r.text for r in spans.spans(files).where(spans.for_people()).collect()}
    now = {(r.file, r.nth): r.text for r in spans.spans(changed).collect()}
    for k, text in was.items():
        assert now[k] == (text if k[0] == "f.txt" else f'«é" \' # & ; {text} 漢»')


def test_refusals(spark):
    files = spark.createDataFrame(FILES, "file string, text string")
    good = edits_of(files, lambda x: F.upper(x))
    refuse = lambda df: {r.file: r.reason for r in spans.edited(files, df).collect() if r.reason}
    assert set(refuse(good.withColumn("start", F.col("start") + 1)).values()) == {"no span at these bytes"}
    assert set(refuse(good.withColumn("hash", F.lit("x"))).values()) == {"the file has changed"}
    assert set(refuse(good.withColumn("style", F.lit("x"))).values()) == {"another style"}
    assert refuse(good.where("file = 'a.json'").withColumn("translation", F.lit("a\u0001b"))) == {"a.json": "not to be written so"}
    two = good.where("file = 'a.json'")
    assert refuse(two.unionByName(two.withColumn("translation", F.lit("other")))) == {"a.json": "edits overlap"}
    moved = files.withColumn("text", F.concat(F.lit(" "), "text"))
    assert {r.reason for r in spans.edited(moved, good).collect() if r.file != "g.bin"} == {"the file has changed"}
    lone = spans.resolved(good.withColumn("file", F.lit("nowhere")), files).select("reason").distinct().collect()
    assert [r.reason for r in lone] == ["no such file"]


def test_edits_shuffle_files_once(spark):
    """Spans are found and checked where a file's row lies: no plan of a write holds more than the join of files with their edits."""
    files = spark.createDataFrame(FILES, "file string, text string")
    plan = spans.edited(files, edits_of(files, lambda x: F.concat(x, F.lit("!"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("MapInArrow") == 2
