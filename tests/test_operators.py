"""Kana, labels and the translation loop on small inputs."""

import pytest
from pyspark.sql import functions as F

from unitflow.functions import kana
from unitflow.operators import glossary, layout, translate


@pytest.mark.parametrize(
    ("text", "target", "kind"),
    [
        ("你好っ", "zh", "edge"),
        ("你好っす", "zh", "mixed"),
        ("你好我们都好「すごい」っ", "zh", "mixed"),
        ("你好「すごい」っ", "zh", "untranslated"),
        ("これはテストです", "zh", "untranslated"),
        ("hello ね", "en", "mixed"),
        ("漢字 ね", "fr", "untranslated"),
        ("これ", "ja", None),
        ("plain", "zh", None),
        ("他的手了ー", "zh", "edge"),
    ],
)
def test_kana_kind(spark, text, target, kind):
    df = spark.createDataFrame([(["clean", text],)], "lines array<string>")
    assert df.select(kana.kana_kind(F.col("lines"), F.lit(target)).alias("k")).first().k == kind


def test_label_shapes(spark):
    rows = [(["【Ann】", "x"], "a"), (["【Bob】", "y"], "b"), (["【Bob】", "z"], "b"), (["[x", "y"], "a"), (["【Cy】"], "a"), (["(a)", "b"], "c"), (["\\C[1]【x】", "b"], "c"), (["【why?】", "b"], "c")]
    got = layout.label_shapes(spark.createDataFrame(rows, "original_lines array<string>, domain string")).orderBy("open").collect()
    assert [(r.open, r.close, r.n_units, r.n_labels, r.domains, r.sample) for r in got] == [("(", ")", 1, 1, "c", "(a)"), ("【", "】", 3, 2, "a,b", "【Ann】")]


def test_translate_loop(spark, tmp_path):
    rows = [(f"u{k}", k // 8, k, "bad word" if k == 5 else f"text {{name}} {k}") for k in range(20)]
    units = spark.createDataFrame(rows, "id string, scene long, ordinal long, text string")

    def model(texts):
        if len(texts) > 1 and any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return ["" if "bad" in t else t.upper() for t in texts]

    def save(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    got = {r.id: r for r in translate.translate(units, model, save, width=4).collect()}
    assert len(got) == 20 and [k for k, r in got.items() if r.passthrough] == ["u5"]
    assert got["u3"].target == "TEXT {name} 3" and got["u5"].error == "empty"


def test_glossary_blocks_find_the_same(spark, monkeypatch):
    units = spark.createDataFrame([(1, "the quick brown fox"), (2, "a brown-fox trot"), (3, "QUICK brown fo"), (4, ""), (5, None)], "doc_id long, text string")
    rows = [("quick brown fox", True), ("brown", True), ("rown fo", True), ("", True), ("Ick", False), ("k b", True), (None, True)]
    terms = spark.createDataFrame(rows, "src string, exact boolean")
    texts = {r.doc_id: r.text or "" for r in units.collect()}
    want = sorted((i, t) for i, x in texts.items() for t, e in rows if t and (t in x or not e and t.lower() in x.lower()))
    for size in (8 << 20, 4):
        monkeypatch.setattr(glossary, "BLOCK_BYTES", size)
        assert sorted((r.doc_id, r.src) for r in glossary.occurrences(units, terms, case_sensitive=F.col("exact")).collect()) == want and want
        known = terms.select("src", F.upper("src").alias("dst"))
        got = glossary.applied(units.withColumn("done", F.when(F.col("doc_id") < 3, F.upper("text"))), known, "text", "done")
        assert sorted((r.doc_id, r.src, r.applied) for r in got.collect()) == sorted((i, t, i < 3) for i, x in texts.items() for t, _ in rows if t and t in x)


def test_glossary_files(spark):
    texts = ['[{"src": "a", "dst": "x", "info": "item"}, {"src": "", "dst": "y"}, {"src": "a", "dst": "z", "case_sensitive": true}]', '{"b": "y", "c": null}', "3", "no json", None]
    terms = glossary.from_json_file(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {r.src: (r.dst, r.info, r.case_sensitive) for r in terms.collect()} == {"a": ("z", "", True), "b": ("y", "", False), "c": ("", "", False)}
    text = glossary.to_json_file(terms.where("src <> 'c'")).first().text
    again = glossary.from_json_file(spark.createDataFrame([(text,)], "text string"))
    assert sorted(again.collect()) == sorted(terms.where("src <> 'c'").collect())


def test_globs():
    import re

    from unitflow.sources import trees

    match = lambda glob, path: re.match(trees.glob_pattern(glob), path + "/") is not None
    assert match("events/*/name", "events/3/name") and not match("events/*/name", "events/3/x/name")
    assert match("**/name", "name") and match("**/name", "a/b/name") and match("a/**", "a") and match("a/**/b", "a/b") and not match("a.c", "abc")
