"""Versions of tables: a change is published whole, or nothing of it."""

import pytest
from pyspark.sql import functions as F

from unitflow.functions import ids
from unitflow.operators import workspace
from unitflow.operators.numbering import numbered, sums_before


@pytest.fixture
def ws(spark, tmp_path):
    return workspace.Workspace(spark, f"file://{tmp_path}/ws")


def units_of(spark, texts):
    rows = [(f"u{k}", f"L{k}", "array" if "\n" in t else "short_text", t.split("\n")) for k, t in texts.items()]
    df = spark.createDataFrame(rows, "id string, location string, item_type string, original_lines array<string>")
    return df.withColumn("source_hash", ids.source_hash(F.col("original_lines")))


def records_of(spark, rows):
    return spark.createDataFrame(rows, "id string, text string, lines array<string>")


def state(ws):
    done = ws.table("translations")
    return ws.manifest()["version"], None if done is None else {r.unit_id: list(r.lines) for r in done.collect()}


def test_changes_are_whole(spark, ws):
    assert ws.manifest() == {"version": 0, "tables": {}, "facts": {}} and ws.table("units") is None
    assert workspace.replace_units(ws, units_of(spark, {1: "Hello {name}", 2: "a\nb", 3: "Third"}), "one") == 1
    assert workspace.import_records(ws, records_of(spark, [("L1", "Hello {name}", ["Salut {name}"]), ("u2", "a\nb", ["c", "d"]), ("L3", "Third", [])])) == 2
    was = state(ws)
    assert was == (2, {"u1": ["Salut {name}"], "u2": ["c", "d"]})
    bad = [("L1", "Hello {name}", ["Salut"]), ("u2", "a\nb", ["c"]), ("u9", "x", ["y"]), ("L3", "other", ["z"]), ("u3", "Third", ["w"])]
    with pytest.raises(workspace.Refused) as e:
        workspace.import_records(ws, records_of(spark, bad))
    assert e.value.reasons == {"a literal is lost": 1, "another structure": 1, "unknown id": 1, "another source text": 1, "more than one record": 1}
    assert workspace.import_records(ws, records_of(spark, [("L3", "Third", ["w"])]), dry_run=True) == 1
    assert workspace.replace_units(ws, units_of(spark, {}), "none", dry_run=True) == 2
    assert state(ws) == was and ws.versions() == [1, 2]
    assert workspace.replace_units(ws, units_of(spark, {1: "Hello you", 2: "a\nb"}), "two") == 3
    assert state(ws) == (3, {"u2": ["c", "d"]}) and ws.manifest()["facts"] == {"snapshot": "two"}
    assert ws.table("translations", 2).count() == 2 and ws.manifest(1)["facts"] == {"snapshot": "one"}
    with pytest.raises(ValueError):
        ws.table("units", 9)


def test_ids_that_are_locations_are_grouped_once_and_versions_are_packed(spark, ws):
    units = units_of(spark, {1: "one", 2: "two", 3: "three"}).withColumn("id", F.when(F.col("id") == "u3", "L2").otherwise(F.col("location")))
    workspace.replace_units(ws, units, "one")  # L1 twice itself; L2 a location, and the id of what lies at L3
    got = {r.id: (r.unit_id, r.fault) for r in workspace.judged(records_of(spark, [("L1", "one", ["x"]), ("L2", "two", ["y"]), ("L3", "three", []), ("L9", "", [])]), ws.table("units")).collect()}
    assert got["L1"] == ("L1", None) and got["L9"] == (None, "unknown id") and got["L2"][0] == "L2" and got["L2"][1] == got["L3"][1] == "more than one record"
    assert all(".zstd." in f for f in ws.table("units").inputFiles())


def test_a_failed_write_changes_nothing(spark, ws):
    workspace.replace_units(ws, units_of(spark, {1: "x y z"}), "one")
    broken = units_of(spark, {2: "new"}).withColumn("id", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        workspace.replace_units(ws, broken, "two")
    assert ws.manifest()["facts"] == {"snapshot": "one"} and ws.versions() == [1] and [r.id for r in ws.table("units").collect()] == ["u1"]
    assert ws.vacuum() >= 1  # what the failed write left
    assert [r.id for r in ws.table("units").collect()] == ["u1"]


def test_the_second_of_two_writers_is_refused(spark, ws):
    workspace.replace_units(ws, units_of(spark, {1: "x"}), "one")
    with pytest.raises(workspace.Conflict):
        ws.commit({"units": units_of(spark, {2: "y"})}, None, since=0)
    with pytest.raises(workspace.Conflict):
        ws._publish(1, "{}")
    assert ws.versions() == [1] and [r.id for r in ws.table("units").collect()] == ["u1"]
    assert not [n for n in ws._listed("manifests") if n.startswith(".") and not n.endswith(".crc")]


def test_saved_batches_and_vacuum(spark, ws):
    batch = lambda *rows: spark.createDataFrame(rows, "unit_id string, source_hash string, lines array<string>, passthrough boolean")
    workspace.save_translations(ws, batch(("a", "h", ["1"], False), ("b", "h", ["2"], False)))
    workspace.save_translations(ws, batch(("b", "h2", ["3"], True), ("c", "h", ["4"], False)))
    assert state(ws) == (2, {"a": ["1"], "b": ["3"], "c": ["4"]})
    assert ws.vacuum(keep=1) == 1 and ws.versions() == [2] and state(ws)[1] == {"a": ["1"], "b": ["3"], "c": ["4"]}


@pytest.mark.parametrize("fan", [2, 3, 2048])
def test_running_numbers(spark, fan):
    df = spark.range(500).select((F.col("id") * 7919 % 97).alias("key"), F.when(F.col("id") % 50 != 0, F.col("id") % 5).alias("more"), F.lit("x").alias("number")).repartition(7)
    got = numbered(df, "key", "more", name="nth", fan=fan).collect()
    assert sorted(r.nth for r in got) == list(range(500))
    ordered = [(r.key, -1 if r.more is None else r.more) for r in sorted(got, key=lambda r: r.nth)]
    assert ordered == sorted(ordered)
    assert numbered(df.limit(0), "key").collect() == []
    sums = spark.createDataFrame([(b, k, (k * 3 + len(b)) % 11) for b in ("p", "qq") for k in range(0, 60, 2)], "by string, key long, n long")
    before = {(r.by, r.key): r.before for r in sums_before(sums, "key", "n", 59, ("by",), fan=fan).collect()}
    rows = [tuple(r) for r in sums.collect()]
    assert before == {(b, k): sum(n for b2, k2, n in rows if b2 == b and k2 < k) for b, k, _ in rows}
