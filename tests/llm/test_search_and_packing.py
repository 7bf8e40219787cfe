"""Ranked search, fill-in-middle and packing against plain Python, the tokenizers library and exhaustive packings."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from unitflow.llm import fill_in_middle, lexical_search, packing, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(A_TO_Z))


def ranked(docs, items, top=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, length = len(counted), sum(k for _, _, k in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, k in counted:
            m = 10 + 90 * k * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def hard_tables(seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.expovariate(0.05))}" for _ in range(300)] + ["É", "漢字", "The", "A1", "x_y", "don't"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(k, text(rng.randint(1, 80))) for k in range(300)]
    docs += [(900 + k, docs[5][1]) for k in range(30)] + [(None, docs[5][1]), (7, docs[7][1]), (1000, None), (1001, ""), (1002, "-- !!"), (1003, text(30_000)), (1004, "w0 " * 50_000)]
    items = [(k, text(rng.randint(1, 20))) for k in range(20)] + [(20, docs[5][1]), (20, docs[5][1]), (None, "the É"), (21, None), (22, "..."), (23, "nowhere")]
    return docs, items


@pytest.mark.parametrize("blocks, query_bytes", [((64, 1 << 16), 1 << 20), ((3, 100), 300)])
def test_search_equals_a_scan(spark, blocks, query_bytes):
    docs, items = hard_tables(3)
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, block string, score int").repartition(5)
    queries_ = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    index = lexical_search.build(df, block_docs=blocks[0], block_terms=blocks[1])
    got = lexical_search.search(index, queries_, query_bytes=query_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items)


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
HARD = ["", None, " ", "a", " a", "a ", "\n\na\tb  c\n", "é漢😀 x y", "has <P> in it", "<S", "a <M>", "< P>x y z", "\x1c x\x85y", "word " * 9_000, "x" * 1_000_000, " " * 500_000 + "end"]


def test_fill_in_middle_by_the_contract(spark):
    rng = random.Random(2)
    texts = HARD + ["".join(rng.choice(["a", "bc", " ", "  ", "\n", "é", "<", "P>", "😀"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = [(None if k == 30 else k, t) for k, t in enumerate(texts)] + [(3, "a b c")] * 3
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(3)
    out = fill_in_middle.transform(df)
    got = out.withColumn("restored", fill_in_middle.restored(out.output, out.form)).collect()
    expected = []
    for i, text in rows:
        text = text or ""
        tokens = TOKEN.findall(text)
        digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
        prefix, middle, suffix = ("".join(tokens[s]) for s in (slice(0, a), slice(a, b), slice(b, None)))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
            expected.append((i, len(tokens), "plain", None, None, text, text))
        elif h[3] % 100 < 80:
            expected.append((i, len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text))
        else:
            expected.append((i, len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_rank_and_select():
    rng = np.random.default_rng(1)
    for n, p in [(1, 1.0), (511, 0.3), (512, 0.01), (5000, 0.5), (5000, 0.001)]:
        bits = rng.random(n) < p
        own, ones = fill_in_middle.RankSelect(bits), np.flatnonzero(bits)
        assert own.rank(np.arange(n + 1)).tolist() == [0, *np.cumsum(bits).tolist()]
        assert own.select(np.arange(len(ones))).tolist() == ones.tolist()


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json")


def test_encoder_against_the_library(vocabulary):
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(vocabulary), packing.Encoder(vocabulary), random.Random(4)
    parts = ["the", "Re", "\n", "\n\n", " ", "  ", "\t", "\r\n", "é", "%%%", "'s", "\x1c", " ", "\xa0", "　", "漢字", "😀", "<|endoftext|>", "12", "|", "<|", "É", ".", ",", "...", "'ll", "?!", "a1", "​", "᠎", "ª", "²"]
    texts = ["", " ", "x" * 300_000, " ." * 9000, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000))]
    for text, ids, want in zip(texts, own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == want.ids, text[:100]


def fewest(lengths, capacity):
    """The fewest bins, by trying all assignments."""
    best = [len(lengths)]

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity:
                put(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        put(k + 1, [*bins, lengths[k]])

    put(0, [])
    return best[0]


def counts_of(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1) if len(lengths) else np.zeros(capacity + 1, np.int64)


def test_patterns_hold_each_length_and_are_few():
    rng = random.Random(6)
    for _ in range(150):
        capacity = rng.choice([10, 17, 24])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        patterns = packing.solve(counts_of(lengths, capacity), capacity, groups=rng.choice([1, 2, 50]))
        held = Counter({})
        for own, times in patterns:
            assert 0 < sum(n * k for n, k in own.items()) <= capacity and times > 0
            held.update({n: k * times for n, k in own.items()})
        assert held == Counter(lengths)
        assert sum(t for _, t in patterns) <= fewest(lengths, capacity) + 1


@pytest.mark.parametrize("lengths, most", [
    ([1025] * 1000 + [512] * 1000 + [511] * 1000, 1000),
    ([1024] * 999, 500),
    ([700] * 3000 + [648] * 3000, 2000),
    ([n for n in range(1, 2049) for _ in range(50)], 51_300),
])
def test_many_pieces(lengths, most):
    patterns = packing.solve(counts_of(lengths, 2048))
    assert sum(t for _, t in patterns) <= most
    assert len(patterns) < 6000


def test_pack_gives_gapless_sequences(spark, vocabulary):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    texts = ["", None, "same text"] + ["same text"] * 200 + ["".join(rng.choice([" the", " of", "\n", " Xyz,", " é"]) for _ in range(rng.randint(0, 900))) for _ in range(150)] + [" word" * 2047, " word" * 2048, " word" * 9000]
    rows = [(None if k == 9 else k, t) for k, t in enumerate(texts)] + [(4, "twice")] * 2
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, length string").repartition(4)
    packed = packing.pack(df, vocabulary, 0).cache()
    library, expected = Tokenizer.from_file(vocabulary), []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        expected += [(i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])), struct.pack(f"<{b - a}H", *ids[a:b])) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
    got = packed.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got), key=str) == sorted(expected, key=str)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(len(e[-1]) // 2 for e in expected)
    assert len(held) <= -(-total // 2048) + 1
    made = packing.sequences(packed).collect()
    assert {r.sequence_id: (r.n_pieces, r.length) for r in made} == {k: (len(v), sum(n for _, n in v)) for k, v in held.items()}
    assert all(len(r.ids) == 2 * r.length for r in made)


def test_op13_sequences_are_few(spark):
    rows = queries.op13_best_fit_packing(spark, "/root/testdata/sf0.01").select("sequence_id", "length").collect()
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.01 * total / 2048 + 1
