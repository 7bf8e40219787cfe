"""The pipeline's stages against plain Python on one small table."""

import math
import re

import numpy as np
import pytest

import corpus_pipeline
from unitflow.llm import decontamination, near_dedup, quality_classifier

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """sf0.001 with hard rows, an extra column, and copies."""
    out = tmp_path_factory.mktemp("pipe")
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'kept' as node")
    long = docs.where("n_chars > 800 and n_chars < 3000").orderBy("doc_id").limit(3).collect()
    rows = [(100000 + i, r.text, r.lang, "copy", r.n_chars, "kept") for i, r in enumerate(long)]
    rows += [(200000 + i, r.text + " And one more end.", r.lang, "near", r.n_chars + 18, "kept") for i, r in enumerate(long)]
    rows += [(None, None, None, None, None, None), (7, None, "en", "s", 0, ""), (300000, "", "fr", "s", 0, ""), rows[0]]
    rows += [(400000, spark.read.parquet(f"{SF}/benchmark.parquet").first().text + " mail jo.hn7@example.com now", "en", "s", 0, "")]
    docs.union(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")).repartition(3).write.parquet(f"{out}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    return str(out)


def key(rows):
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = stages[name](spark, docs, folder)
        if name != "byte_bpe":
            assert out.columns == columns
        rows = out.collect()
        return spark.createDataFrame(rows, out.schema), rows

    verdict = quality_classifier.classify(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    lost = {r.doc_id for r in verdict.where("not kept").collect()}
    docs, rows = step("quality_classifier", docs)
    assert key(rows) == key(r for r in before if r.doc_id not in lost)

    before = rows
    docs, rows = step("near_dedup", docs)
    own = near_dedup.Shingler()
    n = len({r.text or "" for r in before})
    df = {}
    for t in {r.text or "" for r in before}:
        for h in own.shingles(t)[0].tolist():
            df[h] = df.get(h, 0) + 1
    often = sorted(h for h, c in df.items() if c > n / near_dedup.FREQUENT)
    idf = [min(max(math.log(n / df[h]) / math.log(near_dedup.FREQUENT), near_dedup.LEAST_IDF), 1.0) for h in often]
    own = near_dedup.Shingler((np.array(often, np.uint64), np.array(idf)))
    sets = [(r, own.weighted(r.text)) for r in before]
    label = list(range(len(sets)))
    for i, (r, one) in enumerate(sets):
        for j, (s, two) in enumerate(sets[:i]):
            if (r.text or "") == (s.text or "") or own.similarity(one, two) >= 0.8:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = {}
    for (r, _), x in zip(sets, label, strict=True):
        groups.setdefault(x, []).append(r)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(min((r.doc_id is None, r.doc_id or 0, r.doc_id) for r in g)[2]) for g in groups.values())

    before = rows
    docs, rows = step("decontamination", docs)
    index = decontamination.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    assert key(rows) == key(r for r in before if next(decontamination.found_in(r.text, index, 0.5), None) is None)

    before = rows
    docs, rows = step("pii", docs)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in before)
    mails = lambda found: {m for r in found for m in re.findall(r"[\w.]+@[\w.]+", r.text or "")}
    assert mails(before) and not mails(rows) & mails(before)
    plain = lambda found: sorted(str((r.doc_id, r.text)) for r in found if not re.search("[0-9@]", r.text or ""))
    assert plain(rows) == plain(before)
    before = sorted(str((r.doc_id, r.text or "")) for r in rows)
    docs, rows = step("byte_bpe", docs)
    assert sorted(str((r.doc_id, r.text)) for r in rows) == before
    assert sorted(key(corpus_pipeline.run(spark, folder).collect()), key=str) == key(rows)


def test_rejected_and_kept(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r.kept for r in quality_classifier.classify(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()}
    good = [got[r.doc_id] for r in labels.where("quality = 1 and toxic = 0").collect()]
    assert sum(good) >= 0.95 * len(good)


def test_empty_pipeline(spark, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
