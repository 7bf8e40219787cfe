"""Language models against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from unitflow.llm import lm_scoring, near_dedup, quality_classifier


def texts(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    return [" ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randint(0, 60))) for _ in range(n)]


def test_elias_fano():
    rng = np.random.default_rng(2)
    for values in ([], [0], [5, 5, 5], [0, 1 << 40], np.sort(rng.integers(0, 1 << 33, 5000)), np.arange(1000), [3, (1 << 62) + 1], np.cumsum(rng.integers(0, 3, 4000))):
        own = lm_scoring.EliasFano(np.array(values, np.uint64))
        assert own.get(np.arange(len(values))).tolist() == list(values)
    distinct = np.unique(rng.integers(0, 1 << 20, 30_000))
    own, asked = lm_scoring.EliasFano(distinct), np.arange(0, (1 << 20) + 5000, 7)
    at = np.minimum(np.searchsorted(distinct, asked), len(distinct) - 1)
    assert own.find(asked).tolist() == np.where(distinct[at] == asked, at, -1).tolist()


def test_trie_finds_its_keys():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 50, 3000).astype(np.uint64) << np.uint64(32) | rng.integers(0, 1 << 32, 3000).astype(np.uint64))
    p = rng.random(len(keys)) ** 9 + 1e-11
    trie = lm_scoring.Trie(keys, p)
    assert trie.find(keys).tolist() == lm_scoring.quantise(p).tolist()
    others = np.setdiff1d(np.unique(rng.integers(0, 1 << 38, 3000).astype(np.uint64)), keys)
    assert not trie.find(others).any()
    mixed = np.sort(np.concatenate([keys, others]))
    assert (trie.find(mixed) > 0).tolist() == np.isin(mixed, keys).tolist()
    assert np.all(np.abs(np.log2(lm_scoring.restored(lm_scoring.quantise(p)) / p)) < 0.001)
    assert not lm_scoring.Trie(keys[:0], p[:0]).find(keys).any()


@pytest.mark.parametrize("n_buckets, n_shards", [(5, 3), (100_001, 5000)])
def test_score_by_brute_force(spark, monkeypatch, n_buckets, n_shards):
    import zlib

    from unitflow.llm import shared

    monkeypatch.setattr(shared, "MAX_BUCKETS", 6)

    docs = [(i, t) for i, t in enumerate(texts(120))] + [(500, None)]
    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string"), n_buckets=n_buckets, n_shards=n_shards).collect()}
    one, two, before = Counter(), Counter(), Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            own = [*(t or "").split(), "</s>"]
            one.update(own)
            two.update(zip(["<s>", *own], own))
            before.update(["<s>", *own[:-1]])
    n, v = sum(one.values()), len(one)
    for i, t in docs:
        own, total = [*(t or "").split(), "</s>"], 0.0
        for a, w in zip(["<s>", *own], own):
            total += math.log10((two[a, w] + lm_scoring.MU * (one[w] + 1) / (n + v + 1)) / (before[a] + lm_scoring.MU))
        assert got[i].score == pytest.approx(total, abs=0.001 * len(own))
        assert got[i].train_tokens == n


def kneser_ney(train):
    pairs = Counter(p for t in train for p in zip(["<s>", *t.split()], [*t.split(), "</s>"]))
    cont, follow = Counter(w for _, w in pairs), defaultdict(Counter)
    for (a, w), c in pairs.items():
        follow[a][w] = c

    def discounts(counts):
        n = Counter(counts.values())
        if not all(n[k] for k in (1, 2, 3, 4)):
            return 0.5, 1.0, 1.5
        y = n[1] / (n[1] + 2 * n[2])
        return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3))

    d1, d2 = discounts(cont), discounts(pairs)
    cut = lambda d, c: d[min(c, 3) - 1]
    total = sum(cont.values())
    uniform = sum(cut(d1, c) for c in cont.values()) / total / (len(cont) + 1)

    def p(a, w):
        low = (cont[w] - cut(d1, cont[w])) / total + uniform if cont[w] else uniform
        n = sum(follow[a].values())
        if not n:
            return low
        gamma = sum(cut(d2, c) for c in follow[a].values()) / n
        c = follow[a][w]
        return (c - cut(d2, c) if c else 0) / n + gamma * low

    return p, cont


def test_kneser_ney_by_brute_force(spark):
    train, held = texts(150), texts(20, 9) + ["unseen words w1", ""]
    model = quality_classifier.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    p, cont = kneser_ney(train)
    for t, (n, score) in zip(held, model.score(held), strict=True):
        own = list(zip(["<s>", *t.split()], [*t.split(), "</s>"]))
        assert n == len(own) and score == pytest.approx(sum(math.log(p(a, w)) for a, w in own))
    assert sum(p("w1", w) for w in cont) + p("w1", "unseen") == pytest.approx(1)


def test_samples_collide_as_often_as_sets_agree():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    one = rng.choice([0.7, 0.8, 1, 1, 1, 2, 3], len(h))
    two = one.copy()
    two[:200] *= 2
    two[300:450] = 0
    at = np.flatnonzero(two)
    drawn = near_dedup.samples(np.concatenate([h, h[at]]), np.concatenate([one, two[at]]), np.array([0, len(h)]), 3000)
    assert (drawn[0] == drawn[1]).mean() == pytest.approx(np.minimum(one, two).sum() / np.maximum(one, two).sum(), abs=0.03)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (200, 201)]
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 105: 100, 103: 100, 200: 200, 201: 200}
