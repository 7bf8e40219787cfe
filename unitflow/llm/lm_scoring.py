"""Language-model scores of documents from a sharded Elias-Fano n-gram trie.

The model is a bigram model with Dirichlet smoothing towards add-one unigrams:
P(w | v) = (c(vw) + MU * P(w)) / (c(v) + MU), P(w) = (c(w) + 1) / (N + V + 1).
Documents are dealt into buckets of a bounded size. A bucket sends each distinct n-gram it holds once, with its training count, to the shard that its
hash names; a shard adds the counts of all buckets and answers each bucket's n-grams. Words go first; with their counts a
bucket knows what a bigram's probability depends on besides its own count, and sends that with the bigram, so that
shards build their parts of the trie from smoothed probabilities. A frequent context's successors are spread over SLICES parts of
the hash range, so no shard holds them all, and every n-gram crosses the network once for each bucket that holds it.

A shard's trie has a level of contexts (slices of a context are entries of their own), Elias-Fano coded pointers
to their successors, successors sorted within each context, and the smoothed probabilities of the bigrams, quantised to sixteen bits on a logarithmic
scale. Contexts and pointers stay coded while they are queried: a value is found by selecting ones and zeros of a bitmap with a rank directory.
Levels lie in anonymous memory maps. A query finds its context, then searches the successors of that context alone; a bigram
without an entry backs off to MU * P(w) / (c(v) + MU), which is exact.

A null text is an empty text: one end token. Texts of any length are scored whole; one longer than a bucket makes a bucket that long. Documents with a null id are learned from. Rows that repeat are counted and scored each; an empty table
gives an empty result. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import mmap
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.llm.shared import materialize, materialize_by, shuffle_partitions

#: Weight of the unigrams; of 1 to 3000, the best by the log probability of held-out documents lies between 100 and 1000.
MU = 200.0
SLICES = 16
#: Text of a bucket, and of all buckets for each shard; a shard receives some one and a half times as much.
BUCKET_BYTES, SHARD_BYTES = 8 << 20, 16 << 20
#: Lower-cases A-Z and turns blanks into spaces, on bytes.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
#: Tokens that no word equals, as they hold blanks.
END, BEGIN = b" ", b"  "
BEGIN_HASH = np.uint64(xxhash.xxh64_intdigest(BEGIN))


def _level(values: np.ndarray) -> np.ndarray:
    """A copy of an array in an anonymous memory map."""
    if not values.nbytes:
        return values
    place = mmap.mmap(-1, values.nbytes)
    out = np.frombuffer(place, values.dtype)
    out[:] = values
    return out


class EliasFano:
    """A monotone sequence: low bits packed, high bits as gaps in a bitmap, with the number of ones before each of its 64-bit words. All queries
    take arrays and read only the words they need."""

    CHUNK = 1 << 16

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        self.n, self.low_bits = n, max(0, (top // max(n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << self.low_bits) - 1)
        bits = (low[:, None] >> np.arange(self.low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        self.low = _level(np.concatenate([np.packbits(bits.ravel(), bitorder="little"), np.zeros(8, np.uint8)]))
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        self.buckets = int(high[-1]) + 1 if n else 0
        bitmap = np.zeros(-(-(n + self.buckets + 1) // 64) * 64, np.uint8)
        bitmap[high + np.arange(n)] = 1
        words = bitmap.reshape(-1, 64)
        self.high = _level(np.packbits(words, axis=1, bitorder="little").ravel())
        self.ones = _level(np.concatenate([[0], np.cumsum(words.sum(1, dtype=np.int64))]))

    def _select(self, rank: np.ndarray, bit: int) -> np.ndarray:
        """Places of the rank-th ones or zeros."""
        before = self.ones if bit else 64 * np.arange(len(self.ones)) - self.ones
        out = np.empty(len(rank), np.int64)
        for at in range(0, len(rank), self.CHUNK):
            own = rank[at : at + self.CHUNK]
            word = np.searchsorted(before, own, "right") - 1
            bits = np.unpackbits(self.high.reshape(-1, 8)[word], axis=1, bitorder="little")
            seen = np.cumsum(bits if bit else 1 - bits, axis=1, dtype=np.uint8)
            out[at : at + self.CHUNK] = word * 64 + (seen <= (own - before[word])[:, None]).sum(1)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        eight = self.low[(at >> 3)[:, None] + np.arange(8)].view(np.uint64).ravel()
        return eight >> (at & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        i = np.asarray(i, np.int64)
        return (self._select(i, 1) - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of values in a sequence without repeats, -1 for those not in it: the run of equal high bits lies between two zeros."""
        values = np.asarray(values, np.uint64)
        out = np.full(len(values), -1, np.int64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        rows = np.flatnonzero(high < self.buckets)
        if not len(rows):
            return out
        high, want = high[rows], values[rows] & np.uint64((1 << self.low_bits) - 1)
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), 0) + 1 - high, 0)
        stop = self._select(high, 0) - high
        low = _bisect(self._low, start, stop, want)
        inside = np.flatnonzero(low < stop)
        inside = inside[self._low(low[inside]) == want[inside]]
        out[rows[inside]] = low[inside]
        return out


def _bisect(value_at, start: np.ndarray, stop: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The first place of each range [start, stop) whose value is not below the wanted one."""
    low, high = start.copy(), stop.copy()
    while (going := np.flatnonzero(low < high)).size:
        mid = (low[going] + high[going]) // 2
        less = value_at(mid) < want[going]
        low[going[less]], high[going[~less]] = mid[less] + 1, mid[~less]
    return low


#: Codes of the probabilities from 2^-OCTAVES to 1, in equal steps of their logarithm; 0 is no probability.
OCTAVES, STEPS = 48.0, (1 << 16) - 2


def quantise(p: np.ndarray, octaves: float = OCTAVES) -> np.ndarray:
    return (1 + np.round((np.clip(np.log2(p), -octaves, 0) / octaves + 1) * STEPS)).astype(np.uint16)


def restored(codes: np.ndarray, octaves: float = OCTAVES) -> np.ndarray:
    return np.exp2(((codes.astype(float) - 1) / STEPS - 1) * octaves)


class Trie:
    """A shard's bigrams: contexts, pointers, successors and quantised smoothed probabilities, sorted by keys (context above, successor below)."""

    def __init__(self, keys: np.ndarray, p: np.ndarray):
        contexts, first = np.unique((keys >> np.uint64(32)).astype(np.uint32), return_index=True)
        self.contexts = EliasFano(contexts)
        self.pointers = EliasFano(np.concatenate([first, [len(keys)]]))
        self.successors = _level(keys.astype(np.uint32))
        self.codes = _level(quantise(p))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Codes of sorted keys, 0 where there is none: each distinct context is found once, then the successors of that context are searched."""
        out = np.zeros(len(keys), np.uint16)
        if not len(keys):
            return out
        own = keys >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        place = self.contexts.find(own[first])
        known = np.flatnonzero(place >= 0)
        start, stop = np.zeros((2, len(first)), np.int64)
        start[known], stop[known] = self.pointers.get(place[known]), self.pointers.get(place[known] + 1)
        times = np.diff(np.concatenate([first, [len(keys)]]))
        start, stop, want = np.repeat(start, times), np.repeat(stop, times), keys.astype(np.uint32)
        low = _bisect(self.successors.__getitem__, start, stop, want)
        inside = np.flatnonzero(low < stop)
        inside = inside[self.successors[low[inside]] == want[inside]]
        out[inside] = self.codes[low[inside]]
        return out


def _planes(values: np.ndarray) -> bytes:
    """The bytes of an array, the lowest bytes of all values first: the shuffle's codec takes out the empty planes."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, np.uint64), dtype=np.uint64)


class Bucket:
    """A bucket's documents as places of their tokens in the bucket's sorted distinct words."""

    def __init__(self, words: np.ndarray, places: np.ndarray, sizes: np.ndarray):
        self.words, self.places, self.sizes = words, places, sizes  # places: a begin before each document's tokens; sizes without it
        starts = np.zeros(len(places), bool)
        starts[np.cumsum(np.concatenate([[0], sizes[:-1] + 1]))] = True
        own = np.flatnonzero(~starts)
        self.own, self.before = places[own].astype(np.int64), places[own - 1].astype(np.int64)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)

    @classmethod
    def of(cls, texts: list[str | None]) -> Bucket:
        ids: dict[bytes, int] = {BEGIN: 0, END: 1}
        flat: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = [w for w in (text or "").encode().translate(_TABLE).split(b" ") if w]
            flat.append(0)
            flat += [ids.setdefault(w, len(ids)) for w in words]
            flat.append(1)
            sizes[k] = len(words) + 1
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), np.uint64, len(ids))
        words, place = np.unique(hashes, return_inverse=True)
        return cls(words, place[np.array(flat, np.int64)].astype(np.uint32), sizes)

    def packed(self) -> bytes:
        return pickle.dumps((_pack_keys(self.words), _planes(self.places), self.sizes))

    @classmethod
    def unpacked(cls, data: bytes) -> Bucket:
        words, places, sizes = pickle.loads(data)
        return cls(_unpack_keys(words), _unplanes(places, np.uint32), sizes)

    def word_counts(self, learned: np.ndarray) -> np.ndarray:
        """Training counts of the words; the begin token counts documents."""
        words = np.bincount(self.own[learned[self.doc]], minlength=len(self.words))
        words[np.searchsorted(self.words, BEGIN_HASH)] = learned.sum()
        return words.astype(np.uint32)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys of the bigrams, the first token of each, and the place of each token's own among them."""
        h = self.words
        mixed = (h[self.own] ^ (h[self.before] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        successor = mixed >> np.uint64(32)
        context = (h[self.before] >> np.uint64(32)) ^ (successor % np.uint64(SLICES)) << np.uint64(28)
        return np.unique(context << np.uint64(32) | successor, return_index=True, return_inverse=True)


def _bounds(n: int) -> np.ndarray:
    return np.array([(k << 64) // n for k in range(n)], np.uint64)


_ASK = "shard int, bucket int, keys binary, counts binary, prior binary, weight binary, bucketed binary, docs binary"
_ANSWER = "bucket int, kind int, shard int, answer binary, n long, v long"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu: float = MU, n_buckets: int | None = None, n_shards: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of the id modulo 7 is 2 are held out of the training counts. Texts are shuffled and split into words once;
    the bucket's packed words are written by bucket, so that only answers are shuffled to meet them.
    """
    spark = docs.sparkSession
    ident, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = min(shuffle_partitions(spark), (total >> 20) + 1)
    n_buckets = n_buckets or max(-(-total // BUCKET_BYTES), least)
    n_shards = n_shards or max(-(-total // SHARD_BYTES), least)
    held = F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 7 == 2, F.lit(False))
    dealt = docs.select(ident.alias("doc_id"), text.alias("text"), held.alias("held_out"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_buckets)).cast("int").alias("bucket"))
    bounds = _bounds(n_shards)

    def parts(keys: np.ndarray) -> list[tuple[int, slice]]:
        """The shards that have any of the sorted keys, and where: never more of them than keys."""
        of = np.searchsorted(bounds, keys, "right") - 1
        first = np.flatnonzero(np.diff(of, prepend=-1))
        return [(int(of[a]), slice(int(a), int(b))) for a, b in zip(first, [*first[1:], len(keys)], strict=True)]

    def prepare(table: pa.Table) -> pa.Table:
        own, bucket = Bucket.of(table.column("text").to_pylist()), table.column("bucket")[0].as_py()
        held = np.array(table.column("held_out").to_pylist(), bool)
        counts = own.word_counts(~held)
        rows = [(s, bucket, _pack_keys(own.words[k]), _planes(counts[k]), None, None, None, None) for s, k in parts(own.words)]
        return _table(_ASK, [*rows, (-1, bucket, None, None, None, None, own.packed(), pickle.dumps((table.column("doc_id").to_pylist(), held)))])

    def add(asked: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys with training counts, the counts, and the first asking row of each key."""
        known = [(keys[counts > 0], counts[counts > 0]) for keys, counts in asked]
        keys, first, at = np.unique(np.concatenate([a for a, _ in known]), return_index=True, return_inverse=True)
        return keys, np.bincount(at, np.concatenate([c for _, c in known]), len(keys)).astype(np.int64), first

    def answer_words(table: pa.Table) -> pa.Table:
        shard, asked = table.column("shard")[0].as_py(), [(r["bucket"], _unpack_keys(r["keys"]), _unplanes(r["counts"], np.uint32)) for r in table.to_pylist()]
        words, counts, _ = add([r[1:] for r in asked])
        tokens = words != BEGIN_HASH
        rows = [(-1, 0, shard, None, int(counts[tokens].sum()), int(tokens.sum()))]
        for bucket, own, _ in asked:
            at = np.minimum(np.searchsorted(words, own), max(len(words) - 1, 0))
            found = np.where(words[at] == own, counts[at], 0) if len(words) else np.zeros(len(own), np.int64)
            rows.append((bucket, 0, shard, _planes(found.astype(np.int64)), 0, 0))
        return _table(_ANSWER, rows)

    asked = materialize_by(dealt.groupBy("bucket").applyInArrow(prepare, _ASK), "lm-buckets", "bucket", n_buckets)
    words = materialize(asked.where("shard >= 0").select("shard", "bucket", "keys", "counts").groupBy("shard").applyInArrow(answer_words, _ANSWER), "lm-words")
    sums = words.where("bucket = -1").agg(F.sum("n"), F.sum("v")).first()
    n, v = sums[0] or 0, sums[1] or 0

    def answered(found: pa.Table, kind: int) -> list[bytes]:
        rows = sorted(((r["shard"], r["answer"]) for r in found.select(["kind", "shard", "answer"]).to_pylist() if r["kind"] == kind), key=lambda r: r[0])
        return [a for _, a in rows]

    def known(own: Bucket, found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts and add-one probabilities of a bucket's words, and the share that their successors' own probabilities leave."""
        counts = np.concatenate([_unplanes(x, np.int64) for x in answered(found, 0)])
        return counts, (counts + 1) / (n + v + 1), 1 / (counts + mu)

    def ask_pairs(table: pa.Table, found: pa.Table) -> pa.Table:
        own, bucket = Bucket.unpacked(table.column("bucketed")[0].as_py()), table.column("bucket")[0].as_py()
        _, held = pickle.loads(table.column("docs")[0].as_py())
        _, p, share = known(own, found)
        keys, first, pair = own.pairs()
        counts = np.bincount(pair[(~held)[own.doc]], minlength=len(keys)).astype(np.uint32)
        weight = share[own.before[first]]
        prior = quantise(mu * p[own.own[first]] * weight)
        weight = quantise(weight)
        return _table(_ASK, [(s, bucket, _pack_keys(keys[k]), _planes(counts[k]), _planes(prior[k]), _planes(weight[k]), None, None) for s, k in parts(keys)])

    def answer_pairs(table: pa.Table) -> pa.Table:
        shard, asked = table.column("shard")[0].as_py(), [(r["bucket"], _unpack_keys(r["keys"]), _unplanes(r["counts"], np.uint32), r["prior"], r["weight"]) for r in table.to_pylist()]
        keys, counts, first = add([r[1:3] for r in asked])
        prior, weight = (np.concatenate([restored(_unplanes(r[k], np.uint16)[r[2] > 0]) for r in asked])[first] for k in (3, 4))
        trie = Trie(keys, np.minimum(counts * weight + prior, 1.0))
        return _table(_ANSWER, [(bucket, 1, shard, _planes(trie.find(own)), 0, 0) for bucket, own, *_ in asked])

    def meet(table: pa.Table, found: pa.Table) -> pa.Table:
        own = Bucket.unpacked(table.column("bucketed")[0].as_py())
        ids, held = pickle.loads(table.column("docs")[0].as_py())
        counts, p, share = known(own, found)
        _, _, pair = own.pairs()
        codes = np.concatenate([_unplanes(x, np.uint16) for x in answered(found, 1)])[pair]
        c, unigram = counts[own.own], p[own.own]
        scores = np.log10(np.where(codes > 0, restored(codes), mu * unigram * share[own.before]))
        starts = np.concatenate([[0], np.cumsum(own.sizes)[:-1]])
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": held, "n_tokens": own.sizes, "n_known": np.add.reduceat((c > 0).astype(np.int64), starts), "train_tokens": np.full(len(own.sizes), n, np.int64),
            "base_score": np.add.reduceat(np.log10(unigram), starts), "score": np.add.reduceat(scores, starts),
        })

    buckets = asked.where("shard = -1").select("bucket", "bucketed", "docs").groupBy("bucket")
    of_words = words.where("bucket >= 0").select("bucket", "kind", "shard", "answer")
    pairs = buckets.cogroup(of_words.groupBy("bucket")).applyInArrow(ask_pairs, _ASK).select("shard", "bucket", "keys", "counts", "prior", "weight")
    answers = materialize(pairs.groupBy("shard").applyInArrow(answer_pairs, _ANSWER), "lm-pairs").select("bucket", "kind", "shard", "answer")
    return buckets.cogroup(of_words.unionByName(answers).groupBy("bucket")).applyInArrow(meet, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
