"""Game data written in place, and refused where its structure has changed; longest prefixes against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from unitflow.operators import fitting, prefixes
from unitflow.sinks import games as sink
from unitflow.sources import games

PAGE = {"conditions": {"switch1Valid": False}, "list": [
    {"code": 101, "indent": 0, "parameters": ["", 0, 0, 2, "Ann"]}, {"code": 401, "indent": 0, "parameters": ["Hello there friend"]}, {"code": 401, "indent": 0, "parameters": ["and good morning"]},
    {"code": 102, "indent": 0, "parameters": [["Yes please", "No thanks"], 1]}, {"code": 405, "indent": 0, "parameters": ["Once upon a time"]}, {"code": 405, "indent": 0, "parameters": ["there was a game"]}, {"code": 0, "indent": 0, "parameters": []},
]}
SOURCE = {
    "Map001.json": {"displayName": "x", "events": [None, {"id": 7, "name": "EV", "x": 3, "pages": [PAGE]}]},
    "CommonEvents.json": [None, {"id": 1, "name": "c", "list": PAGE["list"][4:6]}],
    "Actors.json": [None, {"id": 5, "name": "Bold hero", "profile": "A brave person", "level": 1}],
    "System.json": {"gameTitle": "My great game", "terms": {"basic": ["Level", None], "messages": {"victory": "You have won"}}, "versionId": 1},
}


def frame(spark, files):
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in files.items()], "name string, text string")


def units_of(spark):
    return games.game_units(frame(spark, SOURCE), F.lit("en"))


def write(spark, live, done=None, rules=None):
    own = units_of(spark)
    done = own.select("location", "domain", F.transform("original_lines", lambda x: F.concat(F.lit("T:"), x)).alias("lines")) if done is None else done
    out = sink.game_files(frame(spark, live), done, sink.anchors(frame(spark, SOURCE)), rules)
    return {r.name: (json.loads(r.text) if r.reason is None else r.text, r.reason) for r in out.collect()}


def test_all_slots(spark):
    got = write(spark, SOURCE)
    assert all(reason is None for _, reason in got.values())
    commands = got["Map001.json"][0]["events"][1]["pages"][0]["list"]
    assert [c["parameters"] for c in commands] == [["", 0, 0, 2, "T:Ann"], ["T:Hello there friend"], ["T:and good morning"], [["T:Yes please", "T:No thanks"], 1], ["T:Once upon a time"], ["T:there was a game"], []]
    assert got["CommonEvents.json"][0][1]["list"][0]["parameters"] == ["T:Once upon a time"]
    assert got["Actors.json"][0][1] == {"id": 5, "name": "T:Bold hero", "profile": "T:A brave person", "level": 1}
    assert got["System.json"][0] == {"gameTitle": "T:My great game", "terms": {"basic": ["T:Level", None], "messages": {"victory": "T:You have won"}}, "versionId": 1}
    assert write(spark, {k: v[0] for k, v in got.items()})["Map001.json"][0] == got["Map001.json"][0]  # written twice


def test_lines_are_fitted(spark):
    done = units_of(spark).where("domain = 'dialogue'").select("location", "domain", F.array(F.lit("One line that is too long for a slot, "), F.lit("two, "), F.lit("three")).alias("lines"))
    commands = write(spark, SOURCE, done, [fitting.Rule(width=20)])["Map001.json"][0]["events"][1]["pages"][0]["list"]
    assert [c["parameters"][0] for c in commands[1:3]] == ["One line that is ", "too long for a slot, two, three"]
    assert len(commands) == 7


def changed(k):
    live = json.loads(json.dumps(SOURCE))
    page = live["Map001.json"]["events"][1]["pages"][0]
    own = page["list"]
    if k == 0:
        own.insert(1, {"code": 401, "indent": 0, "parameters": ["new"]})
    elif k == 1:
        own[1], own[4] = own[4], own[1]
    elif k == 2:
        own[1]["code"] = 405
    elif k == 3:
        own[1]["indent"] = 1
    elif k == 4:
        own[1]["parameters"] = []
    elif k == 5:
        page["conditions"] = {"switch1Valid": True}
    elif k == 6:
        own[3]["parameters"][0].append("Maybe")
    elif k == 7:
        live["Map001.json"]["events"].append({"id": 8, "name": "more", "pages": []})
    return live


@pytest.mark.parametrize("k", range(8))
def test_changed_structures_are_refused(spark, k):
    live = changed(k)
    got = write(spark, live)
    assert got["Map001.json"] == (json.dumps(live["Map001.json"]), "the structure has changed")
    assert all(reason is None for name, (_, reason) in got.items() if name != "Map001.json")


def test_what_may_change_and_what_is_not_there(spark):
    live = json.loads(json.dumps(SOURCE))
    live["Map001.json"]["events"][1]["x"] = 9
    live["Map001.json"]["events"][1]["pages"][0]["list"][1]["parameters"][0] = "Another text"
    live["Actors.json"][1] = {"id": 5, "level": 1}
    got = write(spark, live)
    assert got["Map001.json"][1] is None and got["Actors.json"][1] == "the structure has changed"
    bad = spark.createDataFrame([("Map001.json/9/0/0", "dialogue", ["x"]), ("CommonEvents.json/1/7", "scroll", ["x"]), ("Actors.json/5/level", "base", ["x"]), ("System.json/terms/basic/9", "system", ["x"])], "location string, domain string, lines array<string>")
    assert {n: r for n, (_, r) in write(spark, SOURCE, bad).items()} == {"Map001.json": "no such entry", "CommonEvents.json": "no such command", "Actors.json": "no text here", "System.json": "no such place"}
    assert write(spark, {"Map002.json": "no JSON"})["Map002.json"] == ("no JSON", "no anchor is stored")
    three = spark.createDataFrame([("Map001.json/7/0/3", "choices", ["a", "b", "c"])], "location string, domain string, lines array<string>")
    assert write(spark, SOURCE, three)["Map001.json"][1] == "another number of choices"


def test_longest_prefix_by_brute_force(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("ab#/") for _ in range(rng.randint(1, 5))) for _ in range(80)]
    places = ["".join(rng.choice("ab#/") for _ in range(rng.randint(0, 9))) for _ in range(600)] + [None, "#", "a", ""]
    units = spark.createDataFrame([(k, p, "own") for k, p in enumerate(places)], "id int, location string, name string")
    got = {r.id: r.file for r in prefixes.file_of(units, spark.createDataFrame([(n,) for n in names], "file string")).collect()}
    assert got == {k: max((n for n in names if (p or "").startswith(n + "#")), key=len, default=None) for k, p in enumerate(places)}
