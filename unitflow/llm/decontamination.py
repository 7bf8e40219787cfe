"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of lower-case tokens (letters and digits). Windows of a few tokens that a
text shares with an item are seeds, found by a rolling Karp-Rabin hash and confirmed token by token. Seeds
on one diagonal form matches; the longest match is marked again and again, and what overlaps a marked one is cut to its free part,
until no match of the least length is left. The share of an item's tokens under such tiles is its
coverage, whatever the order in which the passages stand in the text.

Where a text and an item repeat the same seeds so often that their pairs would be many, matches are found by runs of equal
tokens along diagonals instead, one item token at a time: the same tiles in memory that grows with the text alone. A null text or item has no tokens and matches nothing. Items shorter than a seed must occur whole. Rows that repeat are compared
each; ids may be null; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.llm.shared import keyed, materialize

TOKEN = re.compile(r"[^\W_]+")
SEED = 5
MIN_COVERAGE = 0.5
#: Benchmark text that goes to the executors at once; a larger benchmark is compared in blocks.
BLOCK_BYTES = 16 << 20
#: Pairs of equal seeds of a text and an item, or some items, that are listed at once.
MAX_PAIRS = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def _rolled(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of k ids, modulo 2^64, mixed at the end. A window's hash is that of the prefix it ends less that of the prefix
    it begins after, both rolled over the text once: with b the inverse of the base, prefixes are sums of id * b^place."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(len(ids), INVERSE), dtype=np.uint64)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(ids.astype(np.uint64) * powers, dtype=np.uint64)])
    back = np.cumprod(np.full(n, BASE), dtype=np.uint64)
    out = (prefix[k:] - prefix[:-k]) * back * MIX
    return out ^ (out >> np.uint64(29))


class Index:
    """The seeds of a block of benchmark items: sorted hashes with the items and places they come from."""

    def __init__(self, items: list[tuple[int | None, str | None]], seed: int = SEED):
        listed = [tokens_of(t) for _, t in items]
        self.item_ids, self.lengths = [i for i, _ in items], [len(t) for t in listed]
        self.word_ids = {w: k for k, w in enumerate(dict.fromkeys(w for t in listed for w in t), 1)}
        self.tokens = [np.array([self.word_ids[w] for w in t], np.int64) for t in listed]
        self.seeds = {}
        for k in sorted({min(seed, n) for n in self.lengths if n}):
            of = [i for i, n in enumerate(self.lengths) if n and min(seed, n) == k]
            hashes = [_rolled(self.tokens[i], k) for i in of]
            item, place = np.repeat(of, [len(h) for h in hashes]), np.concatenate([np.arange(len(h)) for h in hashes])
            every = np.concatenate(hashes)
            order = np.argsort(every, kind="stable")
            self.seeds[k] = every[order], item[order], place[order]


def tile(matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, text place, item place) of the longest matches, no token under two tiles."""
    heap = [(-n, p, q) for n, p, q in matches]
    heapq.heapify(heap)
    text, item, tiles = set(), set(), []
    while heap:
        n, p, q = heapq.heappop(heap)
        free = [p + d not in text and q + d not in item for d in range(-n)]
        if all(free):
            text.update(range(p, p - n))
            item.update(range(q, q - n))
            tiles.append((-n, p, q))
            continue
        start = None
        for d, ok in enumerate([*free, False]):
            if ok and start is None:
                start = d
            elif not ok and start is not None:
                if d - start >= least:
                    heapq.heappush(heap, (start - d, p + start, q + start))
                start = None
    return tiles


def tile_dense(ids: np.ndarray, whole: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The tiles of tile(), from the tokens: each pass finds the longest free matches, those of one length in order of their places, and marks
    them. A pass takes len(whole) steps over the text."""
    text, item, tiles = np.ones(len(ids), bool), np.ones(len(whole), bool), []
    at_most = len(whole)
    while at_most >= least:
        ends, run = [], np.zeros(len(ids), np.int32)
        best = least - 1
        for q in range(len(whole)):  # run[p]: length of the free match that ends at p and q
            if not item[q]:
                run = np.zeros(len(ids), np.int32)
                continue
            before = np.concatenate([[np.int32(0)], run[:-1]])
            run = np.where((ids == whole[q]) & text, before + np.int32(1), np.int32(0))
            top = int(run.max(initial=0))
            if top > best:
                best, ends = top, []
            if top == best and top >= least:
                ends.append((np.flatnonzero(run == top) - top + 1, q - top + 1))
        if not ends:
            break
        text_at, item_at = np.concatenate([p for p, _ in ends]), np.repeat([q for _, q in ends], [len(p) for p, _ in ends])
        order = np.lexsort((item_at, text_at))
        for p, q in zip(text_at[order].tolist(), item_at[order].tolist(), strict=True):
            if not item.any():
                break
            if item[q] and text[p] and text[p : p + best].all() and item[q : q + best].all():
                text[p : p + best] = item[q : q + best] = False
                tiles.append((best, p, q))
        at_most = best
    return tiles


def tiles_of(ids: np.ndarray, index: Index) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(item, tiles) of each item that shares a seed with a text."""
    for k, (hashes, items, places) in index.seeds.items():
        if len(ids) < k:
            continue
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        at = np.flatnonzero(known[k:] - known[:-k] == k)
        if not len(at):
            continue
        own = _rolled(ids, k)[at]
        low = np.searchsorted(hashes, own, "left")
        hit = hashes[np.minimum(low, len(hashes) - 1)] == own
        at, own, low = at[hit], own[hit], low[hit]
        if not len(at):
            continue
        # A distinct seed of the text and its places, against its places in the items.
        order = np.argsort(low, kind="stable")
        at, low, own = at[order], low[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        times, begin = np.diff(np.concatenate([first, [len(low)]])), low[first]
        n = np.searchsorted(hashes, own[first], "right") - begin
        slot = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        of, item, place = np.repeat(np.arange(len(first)), n), items[slot], places[slot]
        order = np.argsort(item, kind="stable")
        of, item, place = of[order], item[order], place[order]
        starts = np.concatenate([np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])), [len(item)]])
        for low_, high in zip(starts[:-1], starts[1:], strict=True):
            i, mine = int(item[low_]), of[low_:high]
            whole, n = index.tokens[i], times[mine]
            if n.sum() > MAX_PAIRS:
                if tiles := tile_dense(ids, whole, k):
                    yield i, tiles
                continue
            q = np.repeat(place[low_:high], n)
            p = at[np.repeat(first[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            same = np.all([ids[p + d] == whole[q + d] for d in range(k)], axis=0)
            p, q = p[same], q[same]
            if not len(p):
                continue
            order = np.lexsort((p, p - q))
            p, q = p[order], q[order]
            head = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 1) | (np.diff(q) != 1)]))
            run = np.diff(np.concatenate([head, [len(p)]]))
            yield i, tile([(int(r) + k - 1, int(p[f]), int(q[f])) for f, r in zip(head, run, strict=True)], k)


def found_in(text: str | None, index: Index, min_coverage: float) -> Iterator[tuple[int, int, int, int]]:
    """(item, tiles, tokens under them, tokens of the item) of each item that a text covers far enough."""
    ids = np.array([index.word_ids.get(w, 0) for w in tokens_of(text)], np.int64)
    for i, tiles in tiles_of(ids, index):
        covered = sum(n for n, _, _ in tiles)
        if covered >= min_coverage * index.lengths[i]:
            yield i, len(tiles), covered, index.lengths[i]


#: The index of the block a worker met last, by the block's name.
_LAST: dict[str, Index] = {}


def _index_of(name: str, sent, seed: int) -> Index:
    """A block's index, built once in a worker process and not in each of its tasks."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Index(sent.value, seed)
    return _LAST[name]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator]:
    """The number of blocks of about block_bytes of the benchmark's items, and their broadcasts one at a time, each with a name."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1

    def each() -> Iterator:
        for block in range(n):
            own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
            yield uuid.uuid4().hex, spark.sparkContext.broadcast([(r.item_id, r.text) for r in own.toLocalIterator()])

    return n, each()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_coverage: float = MIN_COVERAGE, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each text and item whose coverage is min_coverage or more: doc_id, item_id, n_tiles, n_covered, n_item, coverage.

    The benchmark is the query set: it goes to the executors in blocks of bounded size, and each block meets every text
    in a narrow pass without a shuffle. Of more blocks than one, each is compared and its rows are written before the next is fetched.
    """

    def against(name: str, sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index_of(name, sent, seed)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            for batch in batches:
                rows = [(doc.as_py(), index.item_ids[i], n, covered, whole, covered / whole) for doc, text in zip(batch.column(0), batch.column(1), strict=True) for i, n, covered, whole in found_in(text.as_py(), index, min_coverage)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "n_tiles", "n_covered", "n_item", "coverage"])

        return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, item_id long, n_tiles int, n_covered int, n_item int, coverage double")

    n, blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    if n == 1:
        return against(*next(blocks))
    found = []
    for name, sent in blocks:
        found.append(materialize(against(name, sent), "contaminated"))
        sent.destroy()
    return reduce(DataFrame.unionByName, found)


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_coverage: float = MIN_COVERAGE, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that no benchmark item covers, with all their columns; narrow, like contaminated(). Of more blocks than one, what
    the earlier ones leave is written before the next is fetched."""
    at = docs.columns.index(text_col)

    def without(name: str, sent, kept: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index_of(name, sent, seed)
            for batch in batches:
                clean = [next(found_in(text.as_py(), index, min_coverage), None) is None for text in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return kept.mapInArrow(run, docs.schema)

    n, blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    if n == 1:
        return without(*next(blocks), docs)
    for name, sent in blocks:
        docs = materialize(without(name, sent, docs), "clean")
        sent.destroy()
    return docs
