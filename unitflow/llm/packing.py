"""Best-fit packing of documents into sequences by linear grouping.

A document is its token ids and an end id; one that is longer than a sequence is cut into pieces of a sequence's length, the first of which may be shorter.
Lengths are few (at most the capacity), whatever the number of documents: their histogram is all that the packing needs to know.

Large lengths are put into groups of equally many pieces, each rounded up to its longest. Which groups go together is optimised over
configurations of these few sizes: a linear program whose columns are generated by a knapsack, rounded down. Actual pieces then take the places of their groups
in each configuration, and the gaps are filled best-fit, the largest first, with the small pieces and the few large ones that rounding
down left over. All this works on counts: the result is a list of patterns (lengths that share a sequence) with the times each is used,
whose size depends on the capacity alone.

In Spark, a piece gets its rank among all pieces of its length (a task's own numbers, and sums of the counts of the tasks before it), and a
table of patterns turns (length, rank) into a sequence and an offset. No piece is compared with another one, and the texts are not shuffled.

A null text is an empty text: its end id alone. Texts of any length are encoded whole. Rows that repeat are packed each; ids may be null; an empty
table gives no pieces. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.llm.shared import chunked, keyed, materialize
from unitflow.operators.numbering import sums_before

CAPACITY = 2048
#: Lengths above such a part of the capacity are large and grouped, the others are small; each is tried, and the fewest sequences win.
LARGE = (8, 4, 2)
GROUPS = 64
#: Gaps above which a sequence may be opened again.
GAPS = (0, 1, 2, 4, 8, 16, 32)
#: A worker's cache of encoded parts: entries, and characters of a part that is kept.
MAX_KEPT, LONGEST = 1_000_000, 64
CHUNK_CHARS, LINE_BYTES = 2 << 20, 1 << 14
#: Stands before a part that no space precedes: a lone surrogate, which no valid text contains.
BARE = "\ud800"
_WHITE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000"
#: Where a pre-token always ends: after what is no white space, before a blank.
_BOUND = re.compile(rf"(?<=[^{_WHITE}])(?=[\x09-\x0d ])")
_EDGE = re.compile(rf"[{_WHITE}]")
_POINTS = ".,;:!?#*$%&|<>()"
SPECIAL = "<|endoftext|>"


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def _ranked(path: str):
    """The same merges by rank, several times as fast, for lines of Latin words; None where the order of merges isn't that of the ids."""
    import tiktoken

    model = json.loads(_tokenizer(path).to_str())["model"]
    listed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in listed]
    byte = {chr(b): b for b in listed} | {chr(256 + k): b for k, b in enumerate(others)}  # how a byte-level vocabulary writes bytes
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    joined = [model["vocab"][a + b] for a, b in pairs]
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if all(c in byte for c in t) and t != SPECIAL}
    if model["type"] != "BPE" or model.get("ignore_merges") or joined != sorted(joined) or len(ranks) != len(pairs) + 256:
        return None
    return tiktoken.Encoding("merges", pat_str=r" ?\p{L}+| ?\p{N}+", mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def _bytes_of(path: str) -> np.ndarray:
    """The number of bytes that each id stands for: a byte-level vocabulary writes each byte as a character, special tokens as they are."""
    own = _tokenizer(path)
    return np.array([len(own.id_to_token(i) or "") for i in range(own.get_vocab_size())])


@lru_cache(1)
def _kept(path: str, run: str) -> dict[str, bytes | None]:
    """A worker's cache of encoded parts, which its later tasks of the same run go on with."""
    return {}


class Encoder:
    """Packed ids of texts, without an end id.

    The byte-level pre-tokenizer begins a token at a space that stands before another character than white space, and at a blank that follows one; parts
    between such places are encoded once while the cache holds them. Texts are split at spaces; a text with white space after a space is split at the other
    places instead. A letter or digit and a run of points after it are always two tokens, so a word is encoded once for all the points that may follow.
    """

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        self.vocabulary, self.run = vocabulary, uuid.uuid4().hex
        self.width = 4 if _tokenizer(vocabulary).get_vocab_size() > 1 << 16 else 2
        self.kind = "I" if self.width == 4 else "H"

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in _tokenizer(self.vocabulary).encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str], latin: bool) -> Iterator[bytes]:
        """The ids of each word with a space before it: words are encoded in lines, and ids are dealt out by the bytes they stand for."""
        sizes = [len(w.encode()) + 1 for w in words]
        at = list(chunked(sizes, LINE_BYTES))
        ranked = _ranked(self.vocabulary) if latin else None
        lines = ["".join([" " + w for w in words[low:high]]) for low, high in at]
        encoded = [array(self.kind, ranked.encode_ordinary(x)).tobytes() for x in lines] if ranked else self._library(lines)
        for (low, high), line in zip(at, encoded, strict=True):
            ends = np.cumsum(_bytes_of(self.vocabulary)[np.frombuffer(line, f"<u{self.width}")])
            stops = (np.searchsorted(ends, np.cumsum(sizes[low:high])) + 1) * self.width
            yield from map(line.__getitem__, map(slice, [0, *stops[:-1].tolist()], stops.tolist()))

    @staticmethod
    def _key(chunk: str) -> str:
        return chunk[1:] if chunk[0] == " " and len(chunk) > 1 and not _EDGE.match(chunk[1]) else BARE + chunk

    @staticmethod
    def _ended(chunk: str) -> tuple[str, ...]:
        """A chunk, or its word and the points at its end."""
        word = chunk.rstrip(_POINTS)
        if len(word) == len(chunk) or not word or ord(word[-1]) >= 0x250 or not word[-1].isalnum():
            return (chunk,)
        return word, chunk[len(word) :]

    def _learn(self, kept: dict[str, bytes | None], missing: set[str], passing: list[str]) -> None:
        """Puts parts into the cache; those of several chunks, or too long to keep, are listed in passing."""
        plain = {p for p in missing if p.isalnum()}  # neither points nor white space, and a space before it
        ended, made, bare = [], {}, set()
        for part in missing - plain:
            word = part.rstrip(_POINTS)
            if word.isalnum() and ord(word[-1]) < 0x250:
                ended.append((part, word, BARE + part[len(word) :]))
                continue
            first = part[:1] == BARE
            if not first and (not part or _EDGE.match(part)):
                kept[part] = None  # more white space after the space
                continue
            chunks = filter(None, _BOUND.split(part[1:] if first else " " + part))
            made[part] = [self._key(x) for c in chunks for x in self._ended(c)]
            if len(made[part]) > 2 or len(part) > LONGEST:
                passing.append(part)
        plain.update(w for _, w, _ in ended)
        bare.update(x for _, _, x in ended)
        for keys in made.values():
            for k in keys:
                (bare if k[0] == BARE else plain).add(k)
        spaced, alone = list(plain.difference(kept)), list(bare.difference(kept))
        latin = [w for w in spaced if (w.isascii() or max(w) < "\u0250") and w.isalnum()]
        other = list(set(spaced).difference(latin))
        kept.update(zip(latin, self._spaced(latin, True), strict=True))
        kept.update(zip(other, self._spaced(other, False), strict=True))
        kept.update(zip(alone, self._library([k[1:] for k in alone]), strict=True))
        passing.extend(k for own in (spaced, alone) for k in own if len(k) > LONGEST)
        for part, word, points in ended:
            kept[part] = kept[word] + kept[points]
        for part, keys in made.items():
            kept[part] = b"".join([kept[k] for k in keys])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        kept = _kept(self.vocabulary, self.run)
        for low, high in chunked([len(t) for t in texts], CHUNK_CHARS):
            own, passing = texts[low:high], []
            listed = [t.split(" ") for t in own]
            for parts in listed:
                parts[0] = BARE + parts[0]
            missing = set().union(*listed)
            if len(kept) + len(missing) > MAX_KEPT:
                kept.clear()
            self._learn(kept, missing.difference(kept), passing)
            for text, parts in zip(own, listed, strict=True):
                if SPECIAL in text:
                    yield self._library([text])[0]
                    continue
                try:
                    yield b"".join(map(kept.__getitem__, parts))
                except TypeError:
                    chunks = list(map(self._key, _BOUND.split(text)))
                    self._learn(kept, set(chunks).difference(kept), passing)
                    yield b"".join(map(kept.__getitem__, chunks))
            for part in passing:
                kept.pop(part, None)


def solve(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[int, ...] = LARGE) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: number}, times) that hold counts[length] pieces of each length."""
    left, patterns = counts.astype(np.int64), []
    if left[capacity]:
        patterns.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    packed = [_packed(left.copy(), capacity, groups, k) for k in large]
    return patterns + min(packed, key=lambda found: sum(times for _, times in found))


def _packed(left: np.ndarray, capacity: int, groups: int, large: int) -> list[tuple[dict[int, int], int]]:
    """Patterns for one limit of large lengths.

    Rounding leaves gaps that no piece may be small enough for. So sequences with a gap above a limit are opened again, and their pieces best-fit by actual
    lengths, if that takes fewer sequences.
    """
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}
    for own, times in _substituted(left, *_grouped(left, capacity, groups, large), capacity):
        bins.setdefault(capacity - sum(n * k for n, k in own.items()), []).append((own, times))
    _best_fit(left, bins, capacity)
    used = lambda b: sum(times for listed in b.values() for _, times in listed)
    best = bins
    for limit in GAPS:
        kept = {room: list(listed) for room, listed in bins.items() if room <= limit}
        for room, listed in bins.items():
            for own, times in listed if room > limit else []:
                for n, k in own.items():
                    left[n] += k * times
        _best_fit(left, kept, capacity)
        best = min(best, kept, key=used)
    return [b for listed in best.values() for b in listed]


def _grouped(left: np.ndarray, capacity: int, groups: int, large: int) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """Runs (length, number) of each group, the longest first, and the lengths that groups are rounded up to."""
    lengths = np.flatnonzero(left[capacity // large + 1 :]) + capacity // large + 1
    if len(lengths) <= groups:
        return [[(int(n), int(left[n]))] for n in lengths[::-1]], lengths[::-1]
    size, runs = -(-int(left[lengths].sum()) // groups), [[]]
    room = size
    for n in lengths[::-1].tolist():
        rest = int(left[n])
        while rest:
            if not room:
                runs.append([])
                room = size
            k = min(rest, room)
            runs[-1].append((n, k))
            rest, room = rest - k, room - k
    return runs, np.array([r[0][0] for r in runs])


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> Iterator[tuple[np.ndarray, float]]:
    """Configurations and their (fractional) times that meet the demand exactly with the least sum of times: a revised simplex method whose columns
    a knapsack generates."""
    n = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    demand = demand.astype(float)
    for _ in range(60 * n):
        inverse = np.linalg.inv(columns)
        x, y = inverse @ demand, inverse.sum(0)
        value, taken = _knapsack(sizes, y, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ taken
        up = step > 1e-9
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, step, 1), np.inf)
        columns[:, int(ratio.argmin())] = taken
    x = np.linalg.solve(columns, demand)
    for k in np.argsort(-x):
        if x[k] > 0:
            yield columns[:, k].astype(int), float(x[k])


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the highest value."""
    best, last = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):  # one more piece in each round
        more, of = best.copy(), np.full(capacity + 1, -1)
        for i, (s, v) in enumerate(zip(sizes.tolist(), values.tolist(), strict=True)):
            if v > 0:
                with_ = best[: capacity + 1 - s] + v
                better = with_ > more[s:] + 1e-12
                more[s:][better], of[s:][better] = with_[better], i
        if (of < 0).all():
            break
        last.append(of)
        best = more
    taken, at = np.zeros(len(sizes)), int(best.argmax())
    for of in reversed(last):
        if of[at] >= 0:
            taken[of[at]] += 1
            at -= int(sizes[of[at]])
    return float(best.max()), taken


def _substituted(left: np.ndarray, runs: list[list[tuple[int, int]]], sizes: np.ndarray, capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Configurations with actual lengths in the places of their groups; takes these off from left."""
    if not len(sizes):
        return
    at, ends = [0] * len(runs), [np.cumsum([k for _, k in r]) for r in runs]
    of = lambda g, i: runs[g][int(np.searchsorted(ends[g], i, "right"))][0]
    for config, x in _configurations(sizes, np.array([e[-1] for e in ends]), capacity):
        used = np.flatnonzero(config)
        times = min([int(x + 1e-6), *(int((ends[g][-1] - at[g]) // config[g]) for g in used)])
        if not times:
            continue
        # A sequence takes config[g] pieces in order; what it holds changes where a run of equal lengths ends.
        changes = {0, times}
        for g in used.tolist():
            for end in (ends[g][(ends[g] > at[g]) & (ends[g] < at[g] + times * config[g])] - at[g]).tolist():
                changes |= {end // int(config[g]), -(-end // int(config[g]))}
        marks = sorted(changes)
        for low, high in zip(marks, marks[1:], strict=False):
            own: dict[int, int] = {}
            for g in used.tolist():
                for i in range(int(config[g])):
                    n = of(g, at[g] + low * int(config[g]) + i)
                    own[n] = own.get(n, 0) + 1
            for n, k in own.items():
                left[n] -= k * (high - low)
            yield own, high - low
        for g in used.tolist():
            at[g] += times * int(config[g])


def _best_fit(left: np.ndarray, bins: dict[int, list[tuple[dict[int, int], int]]], capacity: int) -> None:
    """Puts what is left, the longest first, where the least room stays; bins: room to patterns and their times."""
    rooms = sorted(bins)

    def put(room: int, own: dict[int, int], times: int) -> None:
        if room not in bins:
            bins[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        bins[room].append((own, times))

    for n in np.flatnonzero(left)[::-1].tolist():
        rest = int(left[n])
        while rest:
            k = bisect_left(rooms, n)
            room = rooms[k] if k < len(rooms) else capacity
            if k < len(rooms):
                own, times = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[k]
            else:
                own, times = {}, -(-rest // (capacity // n))
            most = room // n  # one that took a piece has the least room still, so it takes all that fit
            full = min(times, rest // most)
            if full:
                put(room - most * n, own | {n: own.get(n, 0) + most}, full)
                rest, times = rest - full * most, times - full
            if times and rest:
                put(room - rest * n, own | {n: own.get(n, 0) + rest}, 1)
                rest, times = 0, times - 1
            if times:
                put(room, own, times)
        left[n] = 0


def _places(patterns: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """For each pattern and length: the key (length, first rank), pieces in a sequence, first sequence, and first offset; sorted by key."""
    rows, ranks, sequence = [], {}, 0
    for own, times in patterns:
        offset = 0
        for n in sorted(own, reverse=True):
            first = ranks.get(n, 0)
            rows.append((n << 48 | first, own[n], sequence, offset))
            ranks[n] = first + own[n] * times
            offset += own[n] * n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table.T)


_PIECES = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, part int, place long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece, written below the shared folder: doc_id, piece, start, length, ids (packed, little-endian), ids_crc32 (of uint32), part
    (the task) and place (its number among the task's pieces of this length). Narrow."""
    own = Encoder(vocabulary)
    end = array(own.kind, [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            held = 0
            for doc, packed in zip(batch.column(0).to_pylist(), own.encode(texts), strict=True):
                ids = packed + end
                n = len(ids) // own.width
                wide = np.frombuffer(ids, f"<u{own.width}").astype("<u4").tobytes()
                stops = range((n - 1) % capacity + 1, n + 1, capacity)
                for k, stop in enumerate(stops):
                    start = stops[k - 1] if k else 0
                    rows.append((doc, k, start, stop - start, ids[start * own.width : stop * own.width], zlib.crc32(wide[4 * start : 4 * stop]), part, int(seen[stop - start])))
                    seen[stop - start] += 1
                held += len(ids)
                if held > CHUNK_CHARS:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return materialize(keyed(docs, id_col, text_col).mapInArrow(run, _PIECES), "pieces")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in _PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def pack(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[int, ...] = LARGE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset.

    The counts of each task's lengths (at most `capacity` rows a task) are summed to ranks by a shuffle; the histogram (at most `capacity` rows) goes to
    the driver, and the table of patterns, bounded by the capacity, to the executors.
    """
    own = pieces(docs, vocabulary, end_id, id_col, text_col, capacity)
    counts = materialize(own.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r.length] = r.n
    top = counts.agg(F.max("part")).first()[0] or 0
    before = sums_before(counts, "part", "n", top, ("length",)).drop("n")
    sent = own.sparkSession.sparkContext.broadcast(_places(solve(histogram, capacity, groups, large)))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, many, sequence, offset = sent.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(keys, n << 48 | r, "right") - 1
        nth = r - (keys[at] & ((1 << 48) - 1))
        return pd.DataFrame({"sequence_id": sequence[at] + nth // many[at], "offset": offset[at] + nth % many[at] * n})

    ranked = own.join(before.hint("merge"), ["length", "part"])  # as large as there are tasks: not for every executor
    ranked = ranked.withColumn("at", placed("length", F.col("before") + F.col("place")))
    return ranked.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame, width: int = 2) -> DataFrame:
    """sequence_id, n_pieces, length and ids of each sequence, from the rows of pack(): one shuffle of the ids."""
    by_offset = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    out = packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.sum("length").alias("length"), by_offset.alias("own"))
    joined = F.aggregate("own", F.lit("").cast("binary"), lambda s, x: F.concat(s, x["ids"]))
    return out.select("sequence_id", "n_pieces", "length", joined.alias("ids"))
