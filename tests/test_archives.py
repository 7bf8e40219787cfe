"""Archives and pages there and back again."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from unitflow.sinks import render
from unitflow.sources import archives, games, markup, tables

PARAGRAPH = '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:br/><w:t xml:space="preserve">words &amp; more</w:t></w:r></w:p><w:p><w:r><w:t>12</w:t></w:r></w:p></w:body></w:document>'
SHARED = '<sst xmlns="s"><si><t>plain cell</t></si><si><r><t>rich </t></r><r><t>cell</t></r><rPh><t>reading</t></rPh></si><si><t>1</t></si></sst>'
CHAPTER = '<html><head><title>no unit</title></head><body><p>First line<br/>second <ruby>x<rt>skip</rt></ruby></p><p><img src="a.png"/></p><div>plain div</div></body></html>'
PACKAGE = '<package><metadata><dc:title>The book</dc:title><dc:language>en</dc:language></metadata></package>'


def packed(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(name, text, zipfile.ZIP_STORED if name == "mimetype" else None)
    return out.getvalue()


CASES = {
    "epub": (packed(**{"mimetype": "application/epub+zip", "OPS/a.opf": PACKAGE, "OPS/one.xhtml": CHAPTER}), [("OPS/a.opf#b00000", ["The book"]), ("OPS/one.xhtml#b00000", ["First line", "second x"]), ("OPS/one.xhtml#b00002", ["plain div"])]),
    "docx": (packed(**{"[Content_Types].xml": "<x/>", "word/document.xml": PARAGRAPH}), [("word/document.xml#b00000", ["Some  words & more"])]),
    "xlsx": (packed(**{"xl/sharedStrings.xml": SHARED, "xl/worksheets/sheet1.xml": "<sheet/>"}), [("si000000", ["plain cell"]), ("si000001", ["rich cell"])]),
}


@pytest.mark.parametrize("kind", CASES)
def test_archives_there_and_back(spark, tmp_path, kind):
    content, want = CASES[kind]
    (tmp_path / f"a.{kind}").write_bytes(content)
    (tmp_path / f"bad.{kind}").write_bytes(b"no archive")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    units = archives.archive_units(files, F.lit("en"), kind, "content", "path")
    assert [(r.location, r.original_lines) for r in units.orderBy("location").collect()] == want
    done = units.withColumn("translation_lines", F.transform("original_lines", lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    out = {r.path.rsplit("/", 1)[-1]: bytes(r.content) for r in archives.render_archives(files.where("path not like '%bad%'"), done, ["path"], kind, "fr").collect()}
    data = out[f"a.{kind}"]
    again = [(loc, text) for loc, _, text in archives.rows_of(kind, data)]
    assert {loc: text.strip().split("\n") for loc, text in again if loc in dict(want)} == {loc: [f"<{x}>" for x in lines] for loc, lines in want}
    with zipfile.ZipFile(io.BytesIO(content)) as a, zipfile.ZipFile(io.BytesIO(data)) as b:
        assert a.namelist() == b.namelist() and [i.compress_type for i in a.infolist()] == [i.compress_type for i in b.infolist()]
        if kind == "epub":
            assert b.read("mimetype") == b"application/epub+zip" and b"<dc:language>fr<" in b.read("OPS/a.opf") and b'<p><img src="a.png"/></p>' in b.read("OPS/one.xhtml")
        if kind == "xlsx":
            assert b"reading" in b.read("xl/sharedStrings.xml")
    with pytest.raises(ValueError):
        archives.archive_units(files, F.lit("en"), "other")


def test_pages_there_and_back(spark):
    page = "<html><title>A title</title><p>One <b>bold</b><br>two</p><p>12</p><ul><li>open<li>next</ul></html>"
    df = spark.createDataFrame([(1, page), (2, "<p>no end <"), (3, None)], "file long, html string")
    units = markup.html_units(df, F.lit("en"), "html", "file")
    done = units.withColumn("translation_lines", F.transform("original_lines", lambda x: F.concat(F.lit("a<b "), x)))
    out = {r.file: r.text for r in render.rendered(df.withColumnRenamed("html", "text"), done, ["file"], markup.html_text).collect()}
    assert out[1].startswith("<html><title>a&lt;b A title</title><p>a&lt;b One bold<br/>a&lt;b two</p><p>12</p>") and out[2] == "<p>no end <" and out[3] is None


def test_json_texts():
    assert render.json_text("mtool", '{"a b": "", "12": "x"}', {"k000000": ["new"]}) == '{\n  "a b": "new",\n  "12": "x"\n}\n'
    assert '"translation": "n\\nm"' in render.json_text("paratranz", '[{"key": "a", "original": "t"}]', {"p000000": ["n", "m"]})
    assert '"message": "n"' in render.json_text("vnt", '[{"name": "A"}, {"message": "t"}]', {"m000001": ["n"]})
    assert render.json_text("i18next", '{"a": ["x", {"b": "y"}]}', {"a/1/b": ["n"]}) == '{\n  "a": [\n    "x",\n    {\n      "b": "n"\n    }\n  ]\n}\n'


def test_shapes():
    shapes = ['[{"key": "a", "original": "x"}]', '[{"message": "x"}]', '{"名": "x"}', '{"a": "a", "b": "x", "c": "y"}', '{"a": "b", "b": "x", "c": "y", "d": "z"}', '{"a": {"b": "x", "c": 1}}', "[]", "{}", "no", None, "3"]
    assert [tables.json_shape(s) for s in shapes] == ["paratranz", "vnt", "mtool", "mtool", "i18next", None, None, None, None, None, None]


def test_game_database(spark):
    system = '{"gameTitle": "My game", "terms": {"basic": ["Level", null], "messages": {"obtain": "%1 found", "x": ""}}}'
    items = '[null, {"id": 4, "name": "Long sword", "description": " Sharp  ", "note": "not this"}]'
    events = '[null, {"id": 2, "list": [{"code": 401, "parameters": ["not open"]}, {"code": 101, "parameters": ["", 0, 0, 2, "\\\\\\\\N[1]"]}, {"code": 401, "parameters": ["Hello there"]}, {"code": 0}, {"code": 401, "parameters": ["late"]}, {"code": 405, "parameters": ["one line"]}, {"code": 0}, {"code": 405, "parameters": ["next line"]}]}]'
    df = spark.createDataFrame([("System.json", system), ("Items.json", items), ("CommonEvents.json", events), ("Map1.json", "broken"), ("Other.json", "[]")], "name string, text string")
    got = {(r.domain, r.location): r.original_lines for r in games.game_units(df, F.lit("en")).collect()}
    assert got == {
        ("system", "System.json/gameTitle"): ["My game"], ("system", "System.json/terms/basic/0"): ["Level"], ("system", "System.json/terms/messages/obtain"): ["%1 found"],
        ("base", "Items.json/4/name"): ["Long sword"], ("base", "Items.json/4/description"): ["Sharp"],
        ("dialogue", "CommonEvents.json/2/1"): ["Hello there"], ("scroll", "CommonEvents.json/2/5"): ["one line"], ("scroll", "CommonEvents.json/2/7"): ["next line"],
    }
