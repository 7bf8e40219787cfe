"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-token boundaries come from arrays, not from a regular expression. Every code point has a class;
a class is a function on the states of a small automaton; functions compose associatively, so a scan over
blocks of the text finds the state before each code point, and with it the places where a pre-token starts.
The resulting slices are merged by rank once each and kept in a bounded cache.

A null text is an empty text and gives no ids. Rows that repeat are encoded each; ids of documents may be
null. An empty table gives an empty result. Texts of any length are encoded whole, in a chunk of their own where they are longer than one; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from unitflow.llm.shared import chunked, keyed

# Classes of code points.
LETTER, NUMBER, OTHER, SHORT, LONG, INNER, JOINING, LAST, BREAK = range(9)
# States: a token just ended, inside letters, numbers, others or white space, after a joining space, with one or two letters of a contraction to come.
START, IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, JOINED, ONE, TWO = range(8)
#: Stands between documents: a lone surrogate, which no valid text contains.
SEPARATOR = "\ud800"
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CACHE_ENTRIES = 700_000
#: Pieces of more bytes are merged one by one with a heap, and not kept.
WIDEST = 48
NEVER = np.int64(1 << 40)
CHUNK_CHARS = 1 << 20
BLOCK = 256


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point, and whether a pre-token starts at it."""
    if kind == BREAK:
        return START, True
    if state == TWO:
        return ONE, False
    if state == ONE:
        return START, False
    if kind in (LETTER, NUMBER, OTHER):
        own = {LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER}[kind]
        return own, state not in (own, JOINED)
    if kind in (SHORT, LONG):
        if state in (IN_OTHER, JOINED):
            return IN_OTHER, False
        return (ONE if kind == SHORT else TWO), True
    if kind == INNER:
        return IN_SPACE, state != IN_SPACE
    return (JOINED if kind == JOINING else START), True


@lru_cache(1)
def _automaton():
    """(generator of each class, composition table, function table, starts[class, state])."""
    gens = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
    known = {g: i for i, g in enumerate(dict.fromkeys([tuple(range(8)), *gens]))}
    todo = list(known)
    while todo:  # closes the generators under composition
        f = todo.pop()
        for g in gens:
            if (h := tuple(g[x] for x in f)) not in known:
                known[h] = len(known)
                todo.append(h)
    funcs = np.array(list(known), dtype=np.uint8)
    compose = np.array([[known[tuple(g[f])] for g in funcs] for f in funcs], dtype=np.uint16)
    starts = np.array([[_step(s, k)[1] for s in range(8)] for k in range(9)])
    return np.array([known[g] for g in gens], dtype=np.uint16), compose, funcs, starts


@lru_cache(1)
def _classes() -> np.ndarray:
    major = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((major.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    table[WHITE] = INNER
    table[ord(SEPARATOR)] = BREAK
    return table


def _kinds(points: np.ndarray) -> np.ndarray:
    """Classes with what lookahead decides: the last space before a word, and contractions."""
    kinds = _classes()[points]
    if not len(points):
        return kinds
    space = kinds == INNER
    ends = space.copy()
    ends[:-1] &= ~space[1:] & (kinds[1:] != BREAK)
    ends[-1] = False
    kinds[ends] = np.where(points[ends] == 0x20, JOINING, LAST)
    at = np.flatnonzero(points == 0x27)
    if len(at):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kinds[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        kinds[at[long]] = LONG
    return kinds


def boundaries(points: np.ndarray) -> np.ndarray:
    """Positions at which a pre-token starts, by an associative scan over transition functions."""
    gens, compose, funcs, starts = _automaton()
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kinds, size = _kinds(points), len(funcs)
    flat = compose.ravel()
    blocks = -(-n // BLOCK)
    own = np.zeros(blocks * BLOCK, dtype=np.uint16)  # function 0 is the identity
    own[:n] = gens[kinds]
    scanned = np.ascontiguousarray(own.reshape(blocks, BLOCK).T)
    for j in range(1, BLOCK):
        scanned[j] = flat[scanned[j - 1].astype(np.int32) * size + scanned[j]]
    before, step = np.zeros(blocks, dtype=np.uint16), 1
    before[1:] = scanned[-1][:-1]
    while step < blocks:  # the same scan over whole blocks, by doubling
        later = flat[before[:-step].astype(np.int32) * size + before[step:]]
        before[step:] = later
        step *= 2
    entry = funcs[before, START]
    after = funcs.ravel()[scanned.astype(np.int32) * 8 + entry].T.ravel()[:n]
    previous = np.empty(n, dtype=np.uint8)
    previous[0], previous[1:] = START, after[:-1]
    return np.flatnonzero(starts.ravel()[kinds.astype(np.int32) * 8 + previous])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: joins the adjacent pair of lowest rank, the leftmost of equals, until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end, back, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n  # a linked list of parts for long pieces
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]], end[i] = False, stop
        if stop < n:
            back[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (b := back[i]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
            heapq.heappush(heap, (r, b, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes lists of texts by one file of ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.place = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        splits = [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        splits.sort()
        self.pairs, self.joined = np.array(splits, dtype=np.int64).T.copy()
        self.cache: dict[str, bytes] = {}

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.joined[at], NEVER)

    def _merge_all(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Merges many pre-tokens at once: a row for each, and in each step the pair of lowest rank of every row."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode()
            if (whole := self.ranks.get(b)) is not None:
                yield p, whole.to_bytes(4, "little")
            elif len(b) <= WIDEST:
                by_width.setdefault(-(-len(b) // 8) * 8, []).append((p, b))
            else:
                yield p, np.array(merge(b, self.ranks), dtype="<u4").tobytes()
        for width, rows in by_width.items():
            sizes = np.array([len(b) for _, b in rows])
            ids = self.of_byte[np.frombuffer(b"".join(b.ljust(width, b"\0") for _, b in rows), dtype=np.uint8).reshape(-1, width)]
            ids[np.arange(width) >= sizes[:, None]] = -1
            ranks = np.full(ids.shape, NEVER)
            ranks[:, :-1] = self._pair_ranks(ids[:, :-1], ids[:, 1:])
            open_rows, columns = np.arange(len(rows)), np.arange(width)
            final = ids.copy()
            while len(open_rows):
                at = ranks.argmin(1)
                low = ranks[np.arange(len(at)), at]
                if not (going := low < NEVER).all():
                    final[open_rows[~going]] = ids[~going]
                    open_rows, ids, ranks, at, low = open_rows[going], ids[going], ranks[going], at[going], low[going]
                    if not len(open_rows):
                        break
                take = np.minimum(columns + (columns > at[:, None]), width - 1)
                ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
                ids[:, -1], ranks[:, -1] = -1, NEVER
                here = np.arange(len(at))
                ids[here, at] = low
                ranks[here, at] = self._pair_ranks(ids[here, at], ids[here, np.minimum(at + 1, width - 1)])
                ranks[here[at == width - 1], -1] = NEVER
                prior = at > 0
                ranks[here[prior], at[prior] - 1] = self._pair_ranks(ids[here[prior], at[prior] - 1], ids[here[prior], at[prior]])
            packed, counts = final.astype("<u4"), (final >= 0).sum(1)
            for (p, _), row, n in zip(rows, packed, counts.tolist(), strict=True):
                yield p, row[:n].tobytes()

    def _packed(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of each piece, merged once while the cache holds it."""
        out = list(map(self.cache.get, pieces))
        if missing := {p for p, o in zip(pieces, out, strict=True) if o is None}:
            found = dict(self._merge_all(list(missing - {SEPARATOR})))
            found[SEPARATOR] = b""
            out = [o if o is not None else found[p] for p, o in zip(pieces, out, strict=True)]
            if len(self.cache) + len(found) > CACHE_ENTRIES:
                self.cache.clear()
            self.cache.update((p, o) for p, o in found.items() if len(p) <= WIDEST)
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        """For each text its ids, packed as little-endian uint32, and the code-point offset of each of its slices."""
        for low, high in chunked([len(t) for t in texts], CHUNK_CHARS):
            joined = SEPARATOR.join(texts[low:high])
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            at = boundaries(points)
            ends = [*at[1:].tolist(), len(points)]
            packed = self._packed(list(map(joined.__getitem__, map(slice, at.tolist(), ends))))
            stops = np.searchsorted(at, np.flatnonzero(points == ord(SEPARATOR)))
            first = [0, *(stops + 1).tolist()]
            for i, j in zip(first, [*stops.tolist(), len(packed)], strict=True):
                own = at[i:j]
                yield b"".join(packed[i:j]), own - own[0] if len(own) else own

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in the decoded text, and its length at the end."""
        return np.concatenate([[0], np.cumsum(self.length[ids])])

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4")
        at = self.offsets(ids)
        return self.blob[np.repeat(self.place[ids] - at[:-1], self.length[ids]) + np.arange(at[-1])].tobytes()


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, little-endian uint32); with offsets=True the code-point
    offsets of the slices that were merged (packed like ids), with decoded=True the bytes that the ids stand for.

    Narrow: no shuffle. Memory is bounded by one Arrow batch, one chunk of text and the cache.
    """
    schema = "doc_id long, n_tokens long, ids binary" + ", offsets binary" * offsets + ", decoded binary" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for whole in batches:
            for low, high in chunked([512] * whole.num_rows, 1 << 19):
                batch = whole.slice(low, high - low)
                texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
                pairs = list(own.encode(texts))
                ids = [p for p, _ in pairs]
                columns = [batch.column(0), pa.array([len(p) // 4 for p in ids], pa.int64()), pa.array(ids, pa.binary())]
                if offsets:
                    columns.append(pa.array([at.astype("<u4").tobytes() for _, at in pairs], pa.binary()))
                if decoded:
                    columns.append(pa.array([own.decode(p) for p in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", *["offsets"] * offsets, *["decoded"] * decoded])

    return keyed(docs, id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded (binary) of packed ids; null ids are no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(p or b"") for p in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return encoded.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{ids_col}` as ids").mapInArrow(run, "doc_id long, decoded binary")
