"""Tables, catalogues, JSON, renderers and the streamed cache on small inputs."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from unitflow.sinks import render
from unitflow.sources import lines, scripts, tables
from unitflow.streaming import cache


def test_csv_records():
    rng = random.Random(1)
    for _ in range(300):
        rows = [["".join(rng.choice(['a', '"', ",", "\n", " ", "é"]) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(2, 4))] for _ in range(rng.randint(1, 4))]
        out = io.StringIO()
        csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]), quoting=csv.QUOTE_ALL).writerows(rows)
        assert tables.csv_records(out.getvalue()) == rows
    assert tables.csv_records('a,b"c,\n"x""y",z\r\n') == [["a", 'b"c', ""], ['x"y', "z"]]
    assert tables.csv_records("") == []
    assert tables.csv_records("a,") == [["a", ""]]
    assert render.csv_text('k,v\n"a,1",b\n', {(1, 1): 'x"y'}) == 'k,v\n"a,1","x""y"\n'


def test_po_entries():
    text = '# c\nmsgid ""\nmsgstr "head"\n\nmsgid "a \\"b\\"\\n"\n"more"\nmsgstr ""\n\nmsgid "one"\nmsgid_plural "many"\nmsgstr[0] ""\n\nmsgctxt "m"\nmsgid "last"\nmsgstr "x"\n'
    assert list(tables.po_entries(text)) == [(1, 'a "b"\nmore'), (3, "last")]


def test_json_leaves():
    got = list(tables.json_leaves('{"z": [1, "a", {"k": true}], "b": {"c": "d"}, "n": null}'))
    assert got == [(-1, "z/0", None, "number"), (0, "z/1", "a", "string"), (-1, "z/2/k", None, "boolean"), (1, "b/c", "d", "string"), (-1, "n", None, "null")]
    for bad in ("NaN", "[" * 200 + "]" * 200, "{"):
        with pytest.raises(ValueError):
            list(tables.json_leaves(bad))


def test_units_in_spark(spark):
    df = spark.createDataFrame([(1, 'head,text\n1,"some words, here"\n'), (2, None)], "file long, text string")
    assert [(r.file, r.location, r.original_lines) for r in tables.csv_units(df, F.lit("en"), "text", "file").orderBy("location").collect()] == [(1, "r000000/0", ["head"]), (1, "r000000/1", ["text"]), (1, "r000001/1", ["some words, here"])]
    df = spark.createDataFrame([(1, json.dumps({"id": "a", "text": "x\ny"}) + "\n\n" + json.dumps({"id": "", "text": ""}))], "file long, text string")
    assert [(r.location, r.original_lines, r.item_type) for r in tables.jsonl_units(df, "text", "file").collect()] == [("a", ["x", "y"], "long_text"), ("line:3", [""], "long_text")]


def test_render_lines_round_trip(spark):
    texts = ["one line\r\n\r\nthree words here\n", "", "solo text", None]
    df = spark.createDataFrame(list(enumerate(texts)), "file long, text string")
    units = lines.txt_units(df, F.lit("en"), "text", "file")
    same = units.select("file", "pos", F.lit("").alias("prefix"), F.col("original_lines")[0].alias("target"))
    assert {r.file: r.text for r in render.lines(df, same, ["file"]).collect()} == dict(enumerate(texts))
    new = same.withColumn("target", F.upper("target"))
    assert {r.file: r.text for r in render.lines(df, new, ["file"]).collect()} == {k: t and t.upper() for k, t in enumerate(texts)}
    names = spark.createDataFrame([("a/b.c.txt",), ("plain",)], "n string").select(render.output_name(F.col("n"), F.lit("fr")).alias("o")).collect()
    assert [r.o for r in names] == ["a/b.c.fr.txt", "plain.fr"]


def test_streamed_cache(spark, tmp_path):
    schema = "unit_id string, updated_at long, target string"
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    cache.upserts(spark, stream(), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([("b", 3, "new"), ("c", 1, "c")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    cache.upserts(spark, stream(), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {(r.unit_id, r.target) for r in cache.latest(spark, f"{tmp_path}/out").collect()} == {("a", "y"), ("b", "new"), ("c", "c")}
    cache.compact(spark, f"{tmp_path}/out", f"{tmp_path}/small")
    assert sorted(cache.latest(spark, f"{tmp_path}/small").collect()) == sorted(cache.latest(spark, f"{tmp_path}/out").collect())
    assert cache.latest(spark, f"{tmp_path}/none") is None


def test_keys_of_any_length_are_texts(spark):
    """Spark's own parser gives nothing for an object with a key of more than 50,000 characters."""
    long = "long key " * 6000
    text = "{" + f'"{long}": "", "short key": 1, "short key": {{"inner key": 2}}' + "}"
    df = spark.createDataFrame([(1, text), (2, '["no object"]'), (3, "{broken"), (4, None)], "f int, text string")
    rows = scripts.json_list_units(df, F.lit("en"), "mtool", "text", "f").orderBy("f", "pos").collect()
    assert [(r.f, r.pos, r.location, r.original_lines) for r in rows] == [(1, 0, "k000000", [long]), (1, 1, "k000001", ["short key"]), (1, 2, "k000002", ["short key"])]


def test_a_catalogue_without_translations_is_written_like_others(spark):
    """Every written catalogue ends with a line feed, one without units in the source language too."""
    files = spark.createDataFrame([(1, 'msgid "Re."\nmsgstr ""'), (2, 'msgid "Hello"\nmsgstr ""'), (3, None)], "f int, text string")
    own = tables.po_units(files, F.lit("en"), "text", "f").withColumn("translation_lines", F.array(F.lit("x")))
    out = {r.f: r.text for r in render.rendered(files, own, ["f"], render.po_text, untouched=False).collect()}
    assert out == {1: 'msgid "Re."\nmsgstr ""\n', 2: 'msgid "Hello"\nmsgstr "x"\n', 3: None}


def test_rows_of_a_batch_are_handed_on_in_pieces(spark):
    """A worker never holds the parsed rows of all texts of a batch."""

    class Held(str):
        n = 0

        def __init__(self, _):
            Held.n += 1

        def __del__(self):
            Held.n -= 1

    df = spark.range(6000, numPartitions=1).select("id", F.lit("x").alias("text"))
    out = tables.exploded(df, "text", ("id",), "held long, value string", lambda t: [(Held.n, Held(t)) for _ in range(10)])
    assert out.agg(F.max("held"), F.count("*"), F.count_distinct("id")).first()[1:] == (60000, 6000)
    assert out.agg(F.max("held")).first()[0] < 2 * tables.OUT_ROWS
