"""Parsers and masks on small inputs."""

from unitflow.functions import masks
from unitflow.sources import markup


def test_leaf_blocks():
    page = '<html><head><title>T &amp; t</title></head><body><!-- <p>no</p> --><div>outer <p>one<br>two</p> tail</div><p><img src="a>b"></p></b><ul><li>x<rt>skip</rt><i>y</i></li></ul><p>open</body></html>'
    assert markup.leaf_blocks(page) == ["T & t", "one\ntwo", "", "xy", "open"]
    assert markup.leaf_blocks("<p>a<p>b</p></p>") == ["b"]
    assert markup.leaf_blocks("") == []


def test_masks_round_trip():
    lines = [r"\C[2]Hi {name}, 50%% of %1$s \\ [CTRL_7]", "", "{0:x} \\!"]
    masked, literals, visible = masks.mask_lines(lines)
    assert masked[0] == "[CTRL_0]Hi [CTRL_1], 50[CTRL_2] of [CTRL_3] [CTRL_4] [CTRL_5]"
    assert visible[1:] == ["", "   "] and [masks.unmask_line(x, literals) for x in masked] == lines
    assert masks.lost_tokens(lines, literals) == 0
    assert masks.lost_tokens(["Hi {name}"], literals) == len(literals) - 1
    assert masks.unmask_line("[CTRL_9]", literals) == "[CTRL_9]"


def test_masks_in_spark(spark):
    df = spark.createDataFrame([(["a {x}", "%d"],), (None,), ([],)], "lines array<string>")
    got = df.select("lines", masks.masked(df.lines).alias("m")).select("lines", masks.unmasked("m.masked", "m.literals").alias("back"), masks.lost("m.masked", "m.literals").alias("lost")).collect()
    assert [(r.back, r.lost) for r in got] == [(["a {x}", "%d"], 2), (None, 0), ([], 0)]
