"""Ranked lexical search with block-max pruning over a forward index.

The index is a table of blocks. A block is a range of documents in the order in which they are read; it holds for each document its terms and their impacts (what
an occurrence adds to a score, but for the term's weight), and for each of its terms the highest impact and the number of documents. Columns
are stored apart, so that bounds are found without reading forward entries.

A search takes the queries in parts of a bounded size. The documents that hold a query term are summed from the blocks' terms and give its weight. A block's bound for a query
is the sum of weight times highest impact; the blocks of the highest bounds of all are scored first, and their
tenth best score is a threshold that no result falls below. Then every task takes its blocks in order of their bounds, scores their forward
entries, and stops where the bound drops below the threshold or below its own tenth best score. Only results are shuffled.

Terms are told apart by 64-bit hashes. A null text has no terms and is no result; a null id comes after others of the same score. Texts of
any length are indexed whole: one that is longer than a block is a block of its own. Rows that repeat are documents of their own, and so
are queries that repeat; queries without terms have no results. An empty table on either side gives an empty result. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitflow.llm.shared import keyed, materialize

#: A-Z in lower case, other ASCII characters than letters and digits as spaces; a term is what is left between spaces.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
TOP = 10
#: Documents of a block, and their terms with repeats.
BLOCK_DOCS, BLOCK_TERMS = 16, 1 << 16
#: Text of the queries that go to the executors at once.
QUERY_BYTES = 1 << 20
#: Blocks that a task sorts by their bounds at once, and the size of the scored grids it holds of these.
SORTED_BLOCKS, GRID_BYTES = 1024, 64 << 20
#: Blocks of the highest bounds that give a query its first threshold.
FIRST_BLOCKS = 4
LENGTH_PERCENT = 90
NO_ID = np.iinfo(np.int64).min


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TERMS).split() if text else []


def _hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term)


def totals(docs: DataFrame) -> tuple[int, int]:
    """The number of documents with a term, and of all their terms. docs: doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for batch in batches:
            for text in batch.column(0):
                n = len(terms_of(text.as_py()))
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
        yield pa.RecordBatch.from_pydict({"n_docs": [n_docs], "n_terms": [n_terms]})

    row = docs.select("text").mapInArrow(run, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return row[0] or 0, row[1] or 0


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


_INDEX = "block long, n_docs int, ids binary, terms binary, highest binary, n_holding binary, starts binary, entries binary, impacts binary"


def _block(name: int, held: list[tuple[int | None, int, Counter]]) -> tuple:
    """A row of the index, from (id, m, counts of terms) of its documents."""
    sizes = [len(c) for _, _, c in held]
    hashes = np.fromiter((_hash(t) for _, _, c in held for t in c), np.uint64, sum(sizes))
    tf = np.fromiter((n for _, _, c in held for n in c.values()), np.int64, sum(sizes))
    value = impacts(tf, np.repeat(np.array([m for _, m, _ in held], np.int64), sizes))
    terms, entry, holding = np.unique(hashes, return_inverse=True, return_counts=True)
    highest = np.zeros(len(terms), np.int64)
    np.maximum.at(highest, entry, value)
    ids = np.array([NO_ID if i is None else i for i, _, _ in held], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return name, len(held), ids.tobytes(), terms.tobytes(), *(x.astype(np.uint32).tobytes() for x in (highest, holding, starts, entry, value))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The index of all documents, written below the shared folder: a row for each block. Two narrow passes over the texts: the
    first for the corpus's totals, on which impacts depend."""
    df = keyed(docs, id_col, text_col)
    n_docs, n_terms = totals(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, size = TaskContext.get().partitionId() << 32, [], 0
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 7]
        fields = [f.split()[0] for f in _INDEX.split(", ")]
        written = lambda: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(_block(name, held), kinds, strict=True)], names=fields)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(text.as_py())
                if not words:
                    continue
                if held and (len(held) == block_docs or size + len(words) > block_terms):
                    yield written()
                    name, held, size = name + 1, [], 0
                m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * len(words) * n_docs // n_terms
                held.append((doc, m, Counter(words)))
                size += len(words)
        if held:
            yield written()

    return materialize(df.mapInArrow(run, _INDEX), "block-index")


class Queries:
    """A part of the queries: their distinct terms, sorted by hash, and the places of each query's terms among them."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        listed = [sorted({_hash(t) for t in terms_of(text)}) for _, text in rows]
        self.item_ids = [i for i, _ in rows]
        self.terms = np.unique(np.array([h for own in listed for h in own], np.uint64))
        self.of = [np.searchsorted(self.terms, np.array(own, np.uint64)) for own in listed]
        self.flat = np.concatenate([*self.of, np.zeros(0, np.int64)]).astype(np.int64)
        self.item = np.repeat(np.arange(len(rows)), [len(x) for x in self.of])
        self.weights = np.zeros(len(self.terms), np.int64)

    def known(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a block's terms, and in the queries' terms, of those that are in both."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        own = np.flatnonzero(self.terms[at] == terms)
        return own, at[own]

    def bounds(self, at: np.ndarray, highest: np.ndarray) -> np.ndarray:
        """The highest score of each query that a block can hold; at, highest: its known terms. Sums stay far below 2^53, so they are exact."""
        value = np.zeros(len(self.terms))
        value[at] = self.weights[at] * highest.astype(np.int64)
        return np.bincount(self.item, value[self.flat], len(self.of)).astype(np.int64)


def _best(found: list[tuple[int, bool, int]], more: list[tuple[int, bool, int]], top: int) -> list[tuple[int, bool, int]]:
    return sorted(found + more)[:top]


class Scorer:
    """Scores blocks for queries, each in order of bounds; holds the best documents of each query and the least score that still counts."""

    def __init__(self, queries: Queries, least: np.ndarray, top: int):
        self.queries, self.least, self.top = queries, np.maximum(least, 1), top
        self.found: dict[int, list[tuple[int, bool, int]]] = {}

    def take(self, batch: pa.RecordBatch, only: dict[int, list[int]] | None = None) -> None:
        """The blocks of a batch, each for all queries or those that `only` names for it."""
        for at in range(0, batch.num_rows, SORTED_BLOCKS):
            self._take(batch.slice(at, SORTED_BLOCKS), only)

    def _take(self, batch: pa.RecordBatch, only: dict[int, list[int]] | None) -> None:
        column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        get = lambda name, k, kind: np.frombuffer(column[name][k].as_buffer(), kind)
        known, pairs = {}, []
        for k in range(batch.num_rows):
            own, at = self.queries.known(get("terms", k, np.uint64))
            bound = self.queries.bounds(at, get("highest", k, np.uint32)[own])
            may = np.flatnonzero(bound >= self.least)
            if only is not None:
                may = np.intersect1d(may, only.get(column["block"][k].as_py(), []))
            if len(may):
                known[k] = own, at
                pairs.append(np.stack([bound[may], np.full(len(may), k), may]))
        if not pairs:
            return
        bound, block, item = np.concatenate(pairs, axis=1)
        # In order of bounds over all queries: a query's own blocks come in order of its bounds.
        dense, size = {}, 0
        for i in np.lexsort((item, block, -bound)).tolist():
            q = int(item[i])
            if bound[i] < self.least[q]:
                continue
            at_block = int(block[i])
            if at_block not in dense:
                own, at = known[at_block]
                starts, entries, value = get("starts", at_block, np.uint32), get("entries", at_block, np.uint32), get("impacts", at_block, np.uint32)
                row = np.full(len(get("terms", at_block, np.uint64)), -1)
                row[own] = np.arange(len(own))
                doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts.astype(np.int64)))
                hit = np.flatnonzero(row[entries] >= 0)
                grid = np.zeros((len(own) + 1, len(starts) - 1), np.int64)
                grid[row[entries[hit]], doc[hit]] = self.queries.weights[at[row[entries[hit]]]] * value[hit].astype(np.int64)
                if size > GRID_BYTES:
                    dense, size = {}, 0
                dense[at_block], size = (grid, at, get("ids", at_block, np.int64)), size + grid.nbytes
            grid, at, ids = dense[at_block]
            mine = np.searchsorted(at, self.queries.of[q])
            mine = mine[(mine < len(at)) & (at[np.minimum(mine, len(at) - 1)] == self.queries.of[q])]
            scores = grid[mine].sum(0)
            good = np.flatnonzero(scores >= self.least[q])
            if len(good):
                best = _best(self.found.get(q, []), [(-int(scores[d]), bool(ids[d] == NO_ID), int(ids[d])) for d in good.tolist()], self.top)
                self.found[q] = best
                if len(best) == self.top:
                    self.least[q] = max(self.least[q], -best[-1][0])

    def rows(self) -> Iterator[pa.RecordBatch]:
        flat = [(q, None if none else doc, -score) for q, found in self.found.items() for score, none, doc in found]
        if flat:
            q, doc, score = zip(*flat, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array([self.queries.item_ids[x] for x in q], pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["query", "item_id", "doc_id", "score"])


_FOUND = "query int, item_id long, doc_id long, score long"


def _search(index: DataFrame, queries: Queries, n_docs: int, top: int) -> DataFrame:
    """query, item_id, doc_id and score of the best documents of each task, the best of all among them."""
    context = index.sparkSession.sparkContext
    sent = context.broadcast(queries)

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = sent.value, np.zeros(len(sent.value.terms), np.int64)
        for batch in batches:
            for terms, n in zip(batch.column(0), batch.column(1), strict=True):
                mine, at = own.known(np.frombuffer(terms.as_buffer(), np.uint64))
                sums[at] += np.frombuffer(n.as_buffer(), np.uint32)[mine]
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], names=["term", "df"])

    dfs = index.select("terms", "n_holding").mapInArrow(holding, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # at most a row for each term of the queries
    for t, df in zip(dfs["term"].tolist(), dfs["df"].tolist(), strict=True):
        queries.weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    sent.destroy()
    weighted = context.broadcast(queries)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = weighted.value
        n = len(own.of)
        best, names, every = np.zeros((FIRST_BLOCKS, n), np.int64), np.zeros((FIRST_BLOCKS, n), np.int64), np.arange(n)
        for batch in batches:
            for block, terms, highest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                mine, at = own.known(np.frombuffer(terms.as_buffer(), np.uint64))
                bound = own.bounds(at, np.frombuffer(highest.as_buffer(), np.uint32)[mine])
                low = best.argmin(0)
                more = np.flatnonzero(bound > best[low, every])
                best[low[more], more], names[low[more], more] = bound[more], block
        k, q = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(names[k, q]), pa.array(best[k, q])], names=["query", "block", "bound"])

    first = index.select("block", "terms", "highest").mapInArrow(bounded, "query int, block long, bound long")
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))).where(F.col("k") <= FIRST_BLOCKS)
    only: dict[int, list[int]] = {}
    for r in ranked.select("query", "block").collect():  # FIRST_BLOCKS rows for each query at most
        only.setdefault(r.block, []).append(r.query)
    chosen = context.broadcast(only)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(weighted.value, np.zeros(len(weighted.value.of), np.int64), top)
        for batch in batches:
            own.take(batch, chosen.value)
        yield from own.rows()

    names = index.sparkSession.createDataFrame([(b,) for b in only], "block long")
    some = index.join(F.broadcast(names), "block", "left_semi").mapInArrow(sampled, _FOUND)
    tenth = some.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("k") == top).select("query", "score").collect()
    least = np.zeros(len(queries.of), np.int64)
    for r in tenth:
        least[r.query] = r.score
    limits = context.broadcast(least)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(weighted.value, limits.value, top)
        for batch in batches:
            own.take(batch)
        yield from own.rows()

    return index.mapInArrow(scored, _FOUND)


def search(index: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The best documents of each query: item_id, rank (from 1), doc_id, score; equal scores by ascending doc_id.

    Queries go out in parts of about query_bytes; of more than one part, each one's results are written before the next is fetched.
    """
    items = queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // query_bytes) or 1
    n_docs = index.agg(F.sum("n_docs")).first()[0] or 0
    found = []
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        part = _search(index, Queries([(r.item_id, r.text) for r in own.toLocalIterator()]), n_docs, top)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
        found.append(part if n == 1 else materialize(part, "found"))
    return reduce(DataFrame.unionByName, found)
