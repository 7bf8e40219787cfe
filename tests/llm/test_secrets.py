"""Entropy windows and spans of long inputs against plain Python."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from unitflow.llm import secret_scan


def brute_entropy(text, window):
    best = 0.0
    for i in range(len(text) - window + 1):
        n = Counter(text[i : i + window])
        best = max(best, math.log2(window) - sum(c * math.log2(c) for c in n.values()) / window)
    return best


def test_window_entropy(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abAB01+/", k=rng.randint(20, 60))) for _ in range(80)] + ["a" * 50, "ab" * 30, "a" * 19, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in df.select("i", secret_scan.window_entropy(F.col("t")).alias("e")).collect():
        assert r.e == pytest.approx(brute_entropy(texts[r.i], secret_scan.WINDOW), abs=1e-9)


def test_long_candidate_and_many_spans(spark):
    """A string of a million characters and a text of 20,000 spans take seconds, not hours."""
    rng = random.Random(5)
    blob = "".join(rng.choices("gh1", k=1_000_000)) + "".join(rng.sample("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghij0123456789", 30))
    many = " x ".join(f"token={rng.randrange(10**9):09d}{k:06d}" for k in range(20_000))
    start = time.time()
    got = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame([(1, "see " + blob + " end"), (2, many)], "doc_id long, text string")).collect()}
    assert time.time() - start < 60
    assert [(s["start"], s["end"], s["kind"]) for s in got[1]] == [(4, 4 + len(blob), "entropy")]
    assert [(s["start"], s["end"]) for s in got[2]] == [m.span() for m in re.finditer(r"token=\d+", many)]


@pytest.mark.parametrize("run", ["Ab/", "Ab-", "A", "a", "a-", "token=", "password = ", "AKIA", "0123456789abcdef", "x1Y2z3A4b5C6d7E8f9G0h1 ", "\"", ": "])
def test_no_text_ends_the_jvm(spark, run):
    text = run * ((1 << 17) // len(run))
    assert len(secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()) == 1
