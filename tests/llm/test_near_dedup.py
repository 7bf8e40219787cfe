"""Classes of near-duplicates against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from unitflow.llm import near_dedup


def all_links(texts, frequent, threshold=near_dedup.THRESHOLD):
    own = near_dedup.Shingler(frequent)
    sets = [own.weighted(t) for t in texts]
    total = [w.sum() for _, w in sets]
    return [(i, j) for i in range(len(sets)) for j in range(i) if threshold * max(total[i], total[j]) <= min(total[i], total[j]) and own.similarity(sets[i], sets[j]) >= threshold]


def components(n, links):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in links:
        a, b = root(i), root(j)
        label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def frequent_of(spark, df):
    keyed = df.selectExpr("coalesce(text, '') as text", "unhex(md5(coalesce(text, ''))) as node")
    return near_dedup.frequent_shingles(keyed, {}, keyed.count())


def test_classes_are_those_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = sorted({r.text or "" for r in docs.collect()})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = all_links(texts, frequent_of(spark, df))
    label = components(len(texts), links)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    caught = sum(got[i] == got[j] for i, j in links)
    print("links between texts:", len(links), "caught:", caught)
    assert links and caught == len(links)
    assert [got[i] for i in range(len(texts))] == label


def crowd(n, rng):
    """Texts that share a passage of two thirds of their words, some of them near copies of one another."""
    passage = " ".join(f"p{k}" for k in range(80))
    texts = []
    for k in range(n):
        own = [f"o{rng.randrange(10**6)}" for _ in range(40)]
        texts.append(f"{passage} {' '.join(own)}")
        if k % 10 == 0:
            own[rng.randrange(3, 37)] = "changed"
            texts.append(f"{passage} {' '.join(own)}")
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [1 << 14, 16])
def test_large_bands_of_unlike_texts(spark, monkeypatch, block):
    """Pairs in the midst of bands that many unlike texts share are found, in one block or many."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(near_dedup, "HUB_ROWS", 8)
    monkeypatch.setattr(near_dedup, "FREQUENT", 1)  # no shingle weighs less, so that the passage counts in full
    texts = crowd(300, random.Random(2))
    links = all_links(texts, (np.zeros(0, np.uint64), np.zeros(0)))
    assert 25 < len(links) < 60
    rows = [*enumerate(texts), (1000, texts[0]), (None, texts[1]), (1001, "word " * 30_000), (1002, "word " * 29_999 + "end")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(7)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == components(len(texts), links)
    assert got[1000] == got[0] and got[None] == got[1] and got[1001] == got[1002] == 1001


def test_equal_texts_without_words(spark):
    df = spark.createDataFrame([(3, ""), (1, None), (2, " "), (4, "one"), (5, "one")], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    assert got == {3: 1, 1: 1, 2: 2, 4: 4, 5: 4}
    assert sorted(r.doc_id for r in near_dedup.keep_one(df).collect()) == [1, 2, 4]


def test_frequent_shingles_by_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choices(["a", "b", "c", "d"], [6, 3, 1, 1], k=rng.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    keys, idf = frequent_of(spark, df)
    own, n = near_dedup.Shingler(), {}
    for t in texts:
        for h in own.shingles(t)[0].tolist():
            n[h] = n.get(h, 0) + 1
    want = {h: c for h, c in n.items() if c > len(texts) / near_dedup.FREQUENT}
    assert keys.tolist() == sorted(want) and want
    assert idf == pytest.approx([min(max(np.log(len(texts) / want[h]) / np.log(near_dedup.FREQUENT), near_dedup.LEAST_IDF), 1.0) for h in keys.tolist()], abs=1e-5)


def test_runs():
    rows = [(1, "a"), (1, "b"), (2, "c"), (2, "d"), (2, "e"), (3, "f")]
    table = pa.table({"k": [a for a, _ in rows], "v": [b for _, b in rows]})
    for size in (1, 2, 3, 10):
        got = [t.column("v").to_pylist() for t in near_dedup._runs(iter(table.to_batches(max_chunksize=size)), 1)]
        assert got == [["a", "b"], ["c", "d", "e"], ["f"]]


def block_of(rows, band):
    """A block of (total, drawn samples) rows in a band."""
    import pyarrow as pa

    drawn = np.array([d for _, d in rows])
    marks = near_dedup.sketches(drawn, near_dedup.band_keys(drawn))
    n = len(rows)
    table = pa.table({"total": [t for t, _ in rows], "sketch": marks, "label": [bytes([k]) for k in range(n)], "own": [0] * n, "band": [band] * n, "one": [0] * n, "two": [0] * n})
    return near_dedup.Block(table, 0.8)


def test_a_pair_meets_in_the_first_band_it_truly_shares():
    """Samples whose lowest bytes alone are equal make no band: a pair is a partner in exactly one of the bands it shares."""
    rng = np.random.default_rng(3)
    met = {}
    for k in range(2000):
        one = rng.integers(0, 1 << 40, 64)
        two = np.where(rng.random(64) < 0.85, one, one + (rng.integers(1, 1 << 20, 64) << 8))  # what differs has the same lowest byte
        shared = np.flatnonzero((near_dedup.band_keys(one[None]) == near_dedup.band_keys(two[None]))[0]).tolist()
        found = [b for b in shared if len(block_of([(100.0, one), (101.0, two)], b).partners(0))]
        assert found == shared[:1]
        met[len(shared)] = met.get(len(shared), 0) + 1
    assert sum(met.values()) - met.get(0, 0) > 1900


def test_no_pair_of_the_threshold_is_lost():
    """Pairs of sets of weighted Jaccard similarity 0.8, in every band they share: lost only by fewer than LEAST_AGREEING equal samples."""
    rng = np.random.default_rng(5)
    n, lost, unbanded = 3000, 0, 0
    for _ in range(n // 100):
        sets = []
        for _ in range(100):
            words = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
            sets += [np.sort(words[:81]), np.sort(words[9:])]  # 72 of 90
        drawn = near_dedup.samples(np.concatenate(sets), np.ones(sum(map(len, sets))), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]))
        keys = near_dedup.band_keys(drawn)
        for k in range(0, 200, 2):
            shared = np.flatnonzero(keys[k] == keys[k + 1])
            if not len(shared):
                unbanded += 1
            elif sum(len(block_of([(81.0, drawn[k]), (81.0, drawn[k + 1])], b).partners(0)) for b in shared) != 1:
                lost += 1
    assert lost == 0 and unbanded <= 5
