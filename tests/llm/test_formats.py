"""Operators against brute force on small fixtures."""

import random
import re

import numpy as np
import public_tokenizers
import pytest

from unitflow.llm import bpe, decontamination, token_counts, token_output

SF = "/root/testdata/sf0.001"


def test_dac_reads_any_token():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 300, 2000), rng.integers(0, 1 << 32, 50), [0, 255, 256, (1 << 32) - 1]])
    rng.shuffle(ids)
    own = token_output.DacFile(token_output.file_bytes(np.array([1, 2]), np.array([3, len(ids) - 3]), ids))
    assert own.all_tokens().tolist() == ids.tolist()
    assert [own.token(i) for i in range(len(ids))] == ids.tolist()
    empty = token_output.DacFile(token_output.file_bytes(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert empty.all_tokens().tolist() == []


def test_bpe_decode_and_offsets(spark):
    texts = ["don't  stop", "", None, "a\n\nb", "é 漢"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = {r.doc_id: r for r in bpe.encode(docs, path, offsets=True).collect()}
    assert np.frombuffer(got[0].offsets, "<u4").tolist() == [0, 3, 5, 6]
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def brute_split(word, pieces, byte_score):
    best = [(0.0, 0)] + [None] * len(word)
    for d in range(1, len(word) + 1):
        n = len(word[d - 1].encode())
        options = [(best[d - 1][0] + n * byte_score, best[d - 1][1] + n)]
        options += [(best[j][0] + pieces[word[j:d]], best[j][1] + 1) for j in range(d) if word[j:d] in pieces]
        best[d] = max(options, key=lambda o: (o[0], -o[1]))
    return best[-1]


def test_token_counts_by_brute_force(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, byte_score = token_counts.zipf_pieces(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs = docs.union(spark.createDataFrame([(None, None, "x", "s", 0), (-1, "", "x", "s", 0), (-2, "漢字 😀\U0001f9ff re re", "x", "s", 0)], docs.schema))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.count_tokens(docs, path).collect():
        splits = [brute_split("▁" + w, pieces, byte_score) for w in re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")]
        assert (r.n_words, r.n_tokens) == (len(splits), sum(n for _, n in splits))
        assert r.log_prob == pytest.approx(sum(s for s, _ in splits))


def test_token_counts_of_hard_rows(spark):
    """A word of many characters, rows that repeat, and extra columns with names of the result."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, byte_score = token_counts.zipf_pieces(path)
    trie = token_counts.UnigramTrie(pieces, byte_score)
    rng = random.Random(6)
    for _ in range(200):
        word = "\u2581" + "".join(rng.choices(["the", "ing", "a", "\u00e9", "\u6f22", "x", "q"], k=rng.randint(0, 12)))
        assert trie.alone(word) == pytest.approx(trie.insert(word))
        assert trie.alone(word) == pytest.approx(brute_split(word, pieces, byte_score)[::-1])
    docs = spark.createDataFrame([(1, "ab" * 400_000, 5, "x"), (1, "ab ab", 5, "x"), (1, "ab ab", 5, "x"), (None, "", 5, "x")], "doc_id long, text string, n_tokens long, kept string")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect()))
    two = 2 * brute_split("\u2581ab", pieces, byte_score)[1]
    assert got == [(0, 0, 0), (1, 1, got[1][2]), (1, 2, two), (1, 2, two)] and got[1][2] > 1000


def brute_coverage(text, item):
    """Greedy string tiling by trying every pair of places."""
    a, b = decontamination.tokens_of(text), decontamination.tokens_of(item)
    used_a, used_b, covered = set(), set(), 0
    least = min(decontamination.SEED, len(b))
    while b:
        best = None
        for p in range(len(a)):
            for q in range(len(b)):
                n = 0
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and p + n not in used_a and q + n not in used_b:
                    n += 1
                if n >= least and (best is None or (n, -p, -q) > best):
                    best = (n, -p, -q)
        if best is None:
            break
        n, p, q = best[0], -best[1], -best[2]
        used_a.update(range(p, p + n))
        used_b.update(range(q, q + n))
        covered += n
    return covered / len(b) if b else 0


def test_decontamination_by_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 20, 30])))) for i in range(12)] + [(99, None), (98, "")]
    texts = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 25))
        own = rng.choice(items[:12])[1].split()
        cut = rng.randint(0, len(own))
        texts.append((i, " ".join([*words, *own[cut:], "X", *own[:cut], *words])))
    texts += [(None, items[2][1]), (61, None), (62, "")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = {(d, i): c for d, t in texts for i, s in items if (c := brute_coverage(t or "", s or "")) >= 0.5}
    for size in (16 << 20, 200):
        got = {(r.doc_id, r.item_id): r.coverage for r in decontamination.contaminated(docs, bench, block_bytes=size).collect()}
        assert got == pytest.approx(expected)
    clean = sorted(str(r.doc_id) for r in decontamination.remove(docs, bench).collect())
    assert clean == sorted(str(d) for d, _ in texts if all(d != x for x, _ in expected))


def test_dense_tiles_are_those_of_the_heap():
    rng = random.Random(8)
    for _ in range(400):
        k = rng.choice([1, 2, 3])
        a = np.array(rng.choices([1, 2, 3], [5, 1, 1], k=rng.randint(1, 25)))
        b = np.array(rng.choices([1, 2, 3], [5, 1, 1], k=rng.randint(k, 12)))
        matches = []
        for p in range(len(a)):
            for q in range(len(b)):
                if p and q and a[p - 1] == b[q - 1]:
                    continue
                n = 0
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                    n += 1
                if n >= k:
                    matches.append((n, p, q))
        assert decontamination.tile_dense(a, b, k) == decontamination.tile(matches, k)


def test_repeated_seeds_of_a_very_long_text(spark):
    """A million equal words against an item of 400 of them: all pairs of their seeds would be 4 * 10^8."""
    item = "word " * 400
    index = decontamination.Index([(1, item), (2, "some other item of six words")])
    assert list(decontamination.found_in("word " * 1_000_000, index, 0.5)) == [(0, 1, 400, 400)]
    docs = spark.createDataFrame([(1, "word " * 50_000, "clash", "x"), (2, "", "c", "y"), (3, None, "c", "z")], "doc_id long, text string, item_id string, hashes string")
    bench = spark.createDataFrame([(1, item, 5)], "item_id long, text string, doc_id long")
    assert [(r.doc_id, r.n_tiles, r.n_covered) for r in decontamination.contaminated(docs, bench).collect()] == [(1, 1, 400)]
    assert sorted(r.doc_id for r in decontamination.remove(docs, bench).collect()) == [2, 3]


def test_rolled_hashes_tell_windows_apart():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 4, 3000)
    for k in (1, 3, 5):
        hashes = decontamination._rolled(ids, k)
        windows = [tuple(ids[p : p + k]) for p in range(len(ids) - k + 1)]
        assert len(set(zip(windows, hashes.tolist(), strict=True))) == len(set(windows)) == len(set(hashes.tolist()))


def test_files_are_cut_by_bytes(spark):
    """Many null ids, repeated rows and a long text: all files but that of the long text are small, and offsets run through them in order of id."""
    rows = [(None, f"null {k}") for k in range(300)] + [(5, "same row")] * 200 + [(k, f"text {k}") for k in range(300)] + [(299, "long " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    files = token_output.output(df, public_tokenizers.path("word_bpe_49k.json"), 2, task_bytes=1000, file_bytes_=200)
    sizes = [r.n_tokens * 2 for r in files.collect()]
    assert len(sizes) > 20 and sorted(sizes)[-2] <= 200
    got = sorted(token_output.read_back(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
