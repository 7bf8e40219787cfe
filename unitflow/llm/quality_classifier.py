"""Quality classifier: perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

The model is fitted on all trusted documents but one in HELD_OUT, and never held whole: n-gram counts, continuation counts and
context totals are summed in shards, which answer each bucket of documents (see Scores). Each language's threshold is a
quantile of the perplexities of all its trusted documents that the model was not fitted on.

Perplexity does not see a few insults in normal prose. The same model's lower order, the continuation probability of a word, is
therefore also fitted on all documents labelled toxic, and a document is rejected too if the highest log ratio of the two over its words is above
the same quantile of the held-out trusted documents. That holds for texts of any length.

Words are lower-case runs of non-blanks; a text ends with an end token. A null text has the end token alone. Texts of fewer words than
MIN_WORDS are not judged by perplexity; all texts are kept where nothing trusted is held out. Languages with no such document of their own, or null, share the threshold of all;
those with fewer than FEW take the higher of their own and that of all.
A document is trusted if all its labels say good and not toxic; null labels don't count as good. Rows that repeat are scored each; ids
may be null; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitflow.llm import lm_scoring
from unitflow.llm.shared import SPACE, chunked, keyed, materialize, materialize_by, shuffle_partitions, words_of

#: No bound: the model is fitted on all trusted documents that are not held out. A caller's own bound takes them in the order of their ids' hashes.
MAX_TRUSTED_DOCS = None
#: Text of a bucket, and of all buckets for each shard.
BUCKET_BYTES, SHARD_BYTES = 14 << 20, 16 << 20
#: Bigrams are asked for in so many turns, by ranges of shards, each of which has its shuffle on disk alone.
TURNS = 2
#: Bits of the hashes that tell bigrams apart.
PAIR_BITS = 52
#: One in so many trusted documents, by another hash of the id, is never fitted on.
HELD_OUT = 5
#: With fewer held-out documents a language's own quantile is not relied on alone.
FEW = 30
QUANTILE = 0.995
#: A document is rejected only if its perplexity is above the quantile by this factor.
MARGIN = 1.1
#: Likewise of the probability ratio of its worst word: a word that toxic text happens to hold once or twice is not enough.
TOXIC_MARGIN = 3.0
MIN_WORDS = 20
MAX_KEPT = 500_000
#: Tokens at either end of a text; words that hold such a control character alone are taken for them.
BEGIN, END = "\x01", "\x02"
#: The seed with which Spark's xxhash64 hashes a string.
SPARK_SEED = 42


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """Ids whose labels are all good and not toxic."""
    good = (F.col(quality_col) == 1) & F.coalesce(F.col(toxic_col) == 0, F.lit(False))
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).where("good").select("doc_id")


def toxic_ids(labels: DataFrame, id_col: str = "doc_id", toxic_col: str = "toxic") -> DataFrame:
    """Ids that a label calls toxic."""
    return labels.where(F.col(id_col).isNotNull() & (F.col(toxic_col) == 1)).select(F.col(id_col).cast("long").alias("doc_id")).distinct()


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    row = counts.agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n = [0, row.n1, row.n2, row.n3, row.n4]
    if not all(n[1:]):
        return 0.5, 1.0, 1.5
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3))


def _discount(d: tuple[float, float, float]) -> Column:
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


class Model:
    """A fitted model: unigrams with backoff weights, and bigrams, each sorted by the hash that names them."""

    def __init__(self, words: np.ndarray, unigram: np.ndarray, backoff: np.ndarray, pairs: np.ndarray, bigram: np.ndarray, unknown: float):
        order, place = np.argsort(words), np.argsort(pairs)
        self.words, self.unigram, self.backoff = words[order], unigram[order], backoff[order]
        self.pairs, self.bigram, self.unknown = pairs[place], bigram[place], unknown
        self.toxic = (np.zeros(0, np.int64), np.zeros(0), 0.0)  # words, unigrams and the unknown word's of toxic text
        self.kept: dict[bytes, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"kept": {}}

    def _hashes(self, listed: list[list[bytes]]) -> np.ndarray:
        kept = self.kept
        if len(kept) > MAX_KEPT:
            kept.clear()
        for w in {w for words in listed for w in words} - kept.keys():
            kept[w] = xxhash.xxh64_intdigest(w, SPARK_SEED)
        return np.fromiter((kept[w] for words in listed for w in words), np.uint64).astype(np.int64)

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: np.ndarray | float) -> np.ndarray:
        if not len(keys):
            return np.broadcast_to(np.asarray(other, float), wanted.shape)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], other)

    def score(self, texts: list[str]) -> list[tuple[int, float]]:
        """(tokens, natural log probability) of each text."""
        return [(n, logs) for n, logs, _ in self.judge(texts)]

    def judge(self, texts: list[str]) -> list[tuple[int, float, float]]:
        """(tokens, natural log probability, highest log ratio of a word in toxic and in trusted text) of each text."""
        listed = [[BEGIN.encode(), *words_of(t.lower()), END.encode()] for t in texts]
        flat = self._hashes(listed)
        before, own = flat[:-1], flat[1:]
        low = self._find(self.words, self.unigram, own, self.unknown)
        p = self._find(self.words, self.backoff, before, 1.0) * low
        p = self._find(self.pairs, self.bigram, before << 1 ^ (before >> 63 & 1) ^ own, p)
        logs = np.concatenate([[0.0], np.cumsum(np.log(p))])
        sizes = np.array([len(w) for w in listed])
        stops = np.cumsum(sizes)
        worst = np.zeros(len(texts))
        if len(self.toxic[0]) and len(texts):
            ratio = np.log(self._find(self.toxic[0], self.toxic[1], flat, self.toxic[2]))
            ratio[1:] -= np.log(low)
            ratio[stops - sizes] = -np.inf  # the begin of a text is no word of it
            worst = np.maximum.reduceat(ratio, stops - sizes)
        return [(int(n - 1), float(logs[b - 1] - logs[b - n]), float(w)) for n, b, w in zip(sizes, stops, worst, strict=True)]


def _counts(texts: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Bigrams (v, w) and continuation counts of words w, each with c."""
    words = F.array_remove(F.split(F.lower(F.col(text_col)), SPACE), "")
    tokens = texts.where(F.col(text_col).isNotNull()).select(F.concat(F.array(F.lit(BEGIN)), words, F.array(F.lit(END))).alias("t"))
    pairs = tokens.select(F.explode(F.transform(F.slice("t", F.lit(1), F.size("t") - 1), lambda x, i: F.struct(x.alias("v"), F.get(F.col("t"), i + 1).alias("w")))).alias("g")).select("g.v", "g.w")
    bigrams = materialize(pairs.groupBy("v", "w").agg(F.count("*").alias("c")), "kn-bigrams")
    return bigrams, materialize(bigrams.groupBy("w").agg(F.count("*").alias("c")), "kn-unigrams")


def _lower(unigrams: DataFrame) -> tuple[DataFrame, float]:
    """The lower order: w and p1, and the probability of an unknown word, 0 if there are none."""
    d1 = _discounts(unigrams)
    total = unigrams.agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.sum(_discount(d1)).alias("d")).first()
    uniform = total.d / total.c / (total.v + 1) if total.c else 0.0
    return unigrams.select("w", ((F.col("c") - _discount(d1)) / (total.c or 1) + uniform).alias("p1")), uniform


def fit_toxic(texts: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes of the words of a bounded table of texts, sorted, their lower-order probabilities, and the unknown word's."""
    lower, unknown = _lower(_counts(texts, text_col)[1])
    table = lower.select(F.xxhash64("w").alias("key"), "p1").toArrow()
    keys, p1 = (table.column(c).to_numpy() for c in ("key", "p1"))
    order = np.argsort(keys)
    return keys[order], p1[order], unknown


def fit(texts: DataFrame, text_col: str = "text") -> Model:
    """Fits the model on a bounded table of texts; its size is bounded by theirs, so it is collected: two numbers for each n-gram."""
    bigrams, unigrams = _counts(texts, text_col)
    d2 = _discounts(bigrams)
    lower, uniform = _lower(unigrams)
    if not uniform:
        none = np.zeros(0)
        return Model(none.astype(np.int64), none, none, none.astype(np.int64), none, 1.0)
    context = bigrams.groupBy("v").agg(F.sum("c").alias("n"), F.sum(_discount(d2)).alias("d")).select("v", "n", (F.col("d") / F.col("n")).alias("gamma"))
    joined = bigrams.join(context, "v").join(lower, "w")
    v, w = F.xxhash64("v"), F.xxhash64("w")
    pair = F.shiftleft(v, 1).bitwiseXOR(F.shiftrightunsigned(v, 63)).bitwiseXOR(w)
    table = joined.select(pair.alias("key"), ((F.col("c") - _discount(d2)) / F.col("n") + F.col("gamma") * F.col("p1")).alias("p")).toArrow()
    words = lower.withColumnRenamed("w", "v").join(context.select("v", "gamma"), "v", "full")
    words = words.select(v.alias("key"), F.coalesce("p1", F.lit(uniform)).alias("p1"), F.coalesce("gamma", F.lit(1.0)).alias("gamma")).toArrow()
    return Model(*(words.column(c).to_numpy() for c in ("key", "p1", "gamma")), *(table.column(c).to_numpy() for c in ("key", "p")), uniform)


class Bucket(lm_scoring.Bucket):
    """A bucket's documents as places of their tokens in its sorted distinct words; tokens as Model has them."""

    @classmethod
    def of(cls, texts: list[str]) -> Bucket:
        ids: dict[bytes, int] = {BEGIN.encode(): 0, END.encode(): 1}
        flat: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = words_of(text.lower())
            flat.append(0)
            flat += [ids.setdefault(w, len(ids)) for w in words]
            flat.append(1)
            sizes[k] = len(words) + 1
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, SPARK_SEED) for w in ids), np.uint64, len(ids))
        words, place = np.unique(hashes, return_inverse=True)
        return cls(words, place[np.array(flat, np.int64)].astype(np.uint32), sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes of the bigrams, the first token of each, and the place of each token's own among them."""
        h = self.words
        mixed = (h[self.own] ^ (h[self.before] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique(mixed >> np.uint64(64 - PAIR_BITS), return_index=True, return_inverse=True)


_DEALT = "bucket long, bucketed binary, docs binary, rows binary"
_ASK = "shard int, bucket long, asked binary"
_ANSWER = "bucket long, kind int, shard int, answer binary, sums array<long>"
_SCORED = "bucket long, place int, doc_id long, language string, n_tokens long, log_ppl double, worst double, trusted boolean"
#: Kinds of answers to a bucket: its documents' marks, its bigrams, its words.
MARKS, PAIRS, WORDS = range(3)
#: Marks of a document: fitted on, toxic, trusted.
FITTED, TOXIC, TRUSTED = 1, 2, 4
#: What a word has: contexts before it, bigrams after it, such bigrams met once, twice and more often, contexts before it in toxic text.
N_SUMS = 6


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def _of_counts(c: np.ndarray) -> list[int]:
    """The sum of counts, how many are not 0, and how many are 1, 2, 3 and 4."""
    return [int(c.sum()), int((c > 0).sum()), *(int((c == k).sum()) for k in (1, 2, 3, 4))]


def _cuts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4."""
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))


def _cut(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c == 1, d[0], np.where(c == 2, d[1], np.where(c > 2, d[2], 0.0)))


class Lower:
    """The lower order of a model, from its counts' sums (see _of_counts)."""

    def __init__(self, sums: list[int]):
        self.total, self.n, *few = sums
        self.d = _cuts(few)
        cut = self.d[0] * few[0] + self.d[1] * few[1] + self.d[2] * (self.n - few[0] - few[1])
        self.unknown = cut / self.total / (self.n + 1) if self.total else 0.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return (c - _cut(c, self.d)) / (self.total or 1) + self.unknown


def _packed(*parts: bytes | np.ndarray) -> bytes:
    data = pickle.dumps(parts)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple:
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Files of shuffles go with the query that wrote them: what it gave is written elsewhere."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _turn(ask, turn: int):
    """ask of one turn, as a plain function, whose signature Spark looks at."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        return ask(turn, table, found)

    return run


def _parts(bounds: np.ndarray, keys: np.ndarray) -> list[tuple[int, slice]]:
    """The shards that have any of the sorted keys, and where: never more of them than keys."""
    of = np.searchsorted(bounds, keys, "right") - 1
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return [(int(of[a]), slice(int(a), int(b))) for a, b in zip(first, [*first[1:], len(keys)], strict=True)]


def _merged(known: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Keys with a count and the sums of their counts over all lists of keys and counts; and for each list, at which of its keys it is the first to count one."""
    keys = np.concatenate([k[c > 0] for k, c in known])
    found, first, at = np.unique(keys, return_index=True, return_inverse=True)
    sums = np.bincount(at, np.concatenate([c[c > 0] for _, c in known]), len(found)).astype(np.int64)
    firsts = np.zeros(len(keys), bool)
    firsts[first] = True
    own, start = [], 0
    for _, c in known:
        mine = np.zeros(len(c), bool)
        n = int((c > 0).sum())
        mine[c > 0] = firsts[start : start + n]
        own.append(mine)
        start += n
    return found, sums, own


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class Scores:
    """Scores of all documents under the model of all that are marked as fitted, and under that of all marked toxic.

    Documents are split into words once, in buckets of a bounded size that are written with their places. A bucket sends each distinct bigram
    once, with its count, to the shard that its hash names. The shard adds the counts of all buckets and answers with the sum, and tells one of them
    to count the bigram for its words; so words are summed in shards of their own. With a word's and a bigram's sums a bucket has all that a probability depends on.
    """

    def __init__(self, docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, rows: bool):
        """marks: doc_id and mark. rows: whether the documents' own rows are kept in the buckets, for kept()."""
        spark, text = docs.sparkSession, F.col(text_col).cast("string")
        total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        least = min(shuffle_partitions(spark), (total >> 20) + 1)
        n_shards = max(-(-total // SHARD_BYTES), least)
        bounds = lm_scoring._bounds(n_shards)
        lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
        own_columns = [F.col(c) for c in docs.columns] if rows else []
        names = [f"c{i}" for i in range(len(own_columns))]
        given = docs.select(F.col(id_col).cast("long").alias("k0"), text.alias("k1"), lang.alias("k2"), *(c.alias(n) for c, n in zip(own_columns, names, strict=True)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket = TaskContext.get().partitionId() << 32
            for batch in batches:
                texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
                lengths = [len(t.encode()) for t in texts]
                n = max(-(-sum(lengths) // BUCKET_BYTES), 1)
                for low, high in chunked(lengths, -(-sum(lengths) // n) + max(lengths, default=0)):
                    part = batch.slice(low, high - low)
                    data = pickle.dumps((part.column(0).to_pylist(), part.column(2).to_pylist()))
                    kept = _packed_rows(part.select(names)) if names else None
                    yield from _table(_DEALT, [(bucket, Bucket.of(texts[low:high]).packed(), data, kept)]).to_batches()
                    bucket += 1

        self.dealt = materialize_by(given.mapInArrow(deal, _DEALT), "kn-buckets", "bucket", max(-(-total // BUCKET_BYTES), least))
        self.schema = docs.schema

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    ids = pickle.loads(r["docs"])[0]
                    yield pa.RecordBatch.from_arrays([pa.array([r["bucket"]] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.int64())], names=["bucket", "place", "doc_id"])

        def marked(table: pa.Table) -> pa.Table:
            return _table(_ANSWER, [(table.column("bucket")[0].as_py(), MARKS, 0, _packed(table.column("place").to_numpy(), table.column("mark").to_numpy()), None)])

        places = self.dealt.select("bucket", "docs").mapInArrow(named, "bucket long, place int, doc_id long")
        of_docs = materialize(places.join(marks, "doc_id").select("bucket", "place", F.col("mark").cast("int").alias("mark")).groupBy("bucket").applyInArrow(marked, _ANSWER), "kn-marks")

        def answers(found: pa.Table, kind: int) -> list[tuple]:
            rows = [r for r in found.to_pylist() if r["kind"] == kind]
            return [_unpacked(r["answer"]) for r in sorted(rows, key=lambda r: r["shard"])]

        def marks_of(own: Bucket, found: pa.Table) -> np.ndarray:
            out = np.zeros(len(own.sizes), np.int64)
            for place, mark in answers(found, MARKS):
                out[place] = mark
            return out

        def bucket_of(table: pa.Table) -> tuple[Bucket, int]:
            return Bucket.unpacked(table.column("bucketed")[0].as_py()), table.column("bucket")[0].as_py()

        def ask_pairs(turn: int, table: pa.Table, found: pa.Table) -> pa.Table:
            own, bucket = bucket_of(table)
            keys, _, pair = own.pairs()
            of_token = marks_of(own, found)[own.doc]
            fitted, toxic = (np.bincount(pair[of_token & m > 0], minlength=len(keys)).astype(np.uint32) for m in (FITTED, TOXIC))
            return _table(_ASK, [(s, bucket, _packed(lm_scoring._pack_keys(keys[k]), lm_scoring._planes(fitted[k]), np.minimum(toxic[k], 1).astype(np.uint8).tobytes())) for s, k in _parts(bounds >> np.uint64(64 - PAIR_BITS), keys) if s * TURNS // n_shards == turn])

        def answer_pairs(table: pa.Table) -> pa.Table:
            shard, rows = table.column("shard")[0].as_py(), [(r["bucket"], *_unpacked(r["asked"])) for r in table.to_pylist()]
            asked = [(b, lm_scoring._unpack_keys(k), lm_scoring._unplanes(c, np.uint32), np.frombuffer(t, np.uint8)) for b, k, c, t in rows]
            keys, sums, firsts = _merged([(k, c) for _, k, c, _ in asked])
            _, _, toxic_firsts = _merged([(k, t) for _, k, _, t in asked])
            rows = [(-1, PAIRS, shard, None, _of_counts(sums))]
            for (bucket, own, _, _), one, two in zip(asked, firsts, toxic_firsts, strict=True):
                rows.append((bucket, PAIRS, shard, _packed(lm_scoring._planes(_looked_up(keys, sums, own).astype(np.uint32)), (one + 2 * two).astype(np.uint8).tobytes()), None))
            return _table(_ANSWER, rows)

        def pair_counts(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            got = answers(found, PAIRS)
            return np.concatenate([lm_scoring._unplanes(c, np.uint32) for c, _ in got]).astype(np.int64), np.concatenate([np.frombuffer(f, np.uint8) for _, f in got])

        def ask_words(table: pa.Table, found: pa.Table) -> pa.Table:
            own, bucket = bucket_of(table)
            _, first, _ = own.pairs()
            c, told = pair_counts(found)
            one, two = np.flatnonzero(told & 1), np.flatnonzero(told & 2)
            before, after, c, n = own.before[first[one]], own.own[first[one]], c[one], len(own.words)
            each = [np.bincount(after, minlength=n), np.bincount(before, c, n), *(np.bincount(before[t], minlength=n) for t in (c == 1, c == 2, c > 2)), np.bincount(own.own[first[two]], minlength=n)]
            each = [x.astype(np.int64) for x in each]
            return _table(_ASK, [(s, bucket, _packed(lm_scoring._pack_keys(own.words[k]), lm_scoring._planes(np.concatenate([x[k] for x in each])))) for s, k in _parts(bounds, own.words)])

        def answer_words(table: pa.Table) -> pa.Table:
            shard, rows = table.column("shard")[0].as_py(), [(r["bucket"], *_unpacked(r["asked"])) for r in table.to_pylist()]
            asked = [(b, lm_scoring._unpack_keys(k), lm_scoring._unplanes(c, np.int64).reshape(N_SUMS, -1)) for b, k, c in rows]
            keys, at = np.unique(np.concatenate([k for _, k, _ in asked]), return_inverse=True)
            sums = np.stack([np.bincount(at, np.concatenate([x[i] for _, _, x in asked]), len(keys)).astype(np.int64) for i in range(N_SUMS)])
            rows = [(-1, WORDS, shard, None, _of_counts(sums[0]) + _of_counts(sums[-1]))]
            rows += [(bucket, WORDS, shard, _packed(lm_scoring._planes(sums[:, np.searchsorted(keys, own)].ravel())), None) for bucket, own, _ in asked]
            return _table(_ANSWER, rows)

        def added(found: DataFrame, n: int) -> list[int]:
            return [x or 0 for x in found.where("bucket = -1").agg(*(F.sum(F.col("sums")[i]) for i in range(n))).first()]

        buckets = self.dealt.select("bucket", "bucketed").groupBy("bucket")
        with _shuffles_dropped(spark):
            turns = [buckets.cogroup(of_docs.groupBy("bucket")).applyInArrow(_turn(ask_pairs, turn), _ASK) for turn in range(TURNS)]
            of_pairs = reduce(DataFrame.unionByName, [materialize(asked.groupBy("shard").applyInArrow(answer_pairs, _ANSWER), "kn-pairs") for asked in turns])
            of_words = materialize(buckets.cogroup(of_pairs.where("bucket >= 0").groupBy("bucket")).applyInArrow(ask_words, _ASK).groupBy("shard").applyInArrow(answer_words, _ANSWER), "kn-words")
        cuts, sums = _cuts(added(of_pairs, 6)[2:]), added(of_words, 12)
        self.lower, self.toxic = lower, toxic = Lower(sums[:6]), Lower(sums[6:])

        def meet(table: pa.Table, found: pa.Table) -> pa.Table:
            own, bucket = bucket_of(table)
            ids, langs = pickle.loads(table.column("docs")[0].as_py())
            marks = marks_of(own, found)
            _, _, pair = own.pairs()
            c = pair_counts(found)[0][pair]
            got = [lm_scoring._unplanes(a, np.int64).reshape(N_SUMS, -1) for (a,) in answers(found, WORDS)]
            cont, n, n1, n2, n3, bad = np.concatenate(got, axis=1)
            low = lower.p(cont) if lower.total else np.ones(len(cont))
            gamma = np.where(n > 0, (cuts[0] * n1 + cuts[1] * n2 + cuts[2] * n3) / np.maximum(n, 1), 1.0)
            p = gamma[own.before] * low[own.own] + np.where(c > 0, (c - _cut(c, cuts)) / np.maximum(n, 1)[own.before], 0.0)
            starts = np.cumsum(own.sizes) - own.sizes
            worst = np.maximum.reduceat((np.log(toxic.p(bad)) - np.log(low))[own.own], starts) if toxic.total else np.zeros(len(ids))
            return pa.table({
                "bucket": pa.array([bucket] * len(ids), pa.int64()), "place": pa.array(range(len(ids)), pa.int32()), "doc_id": pa.array(ids, pa.int64()), "language": pa.array(langs, pa.string()), "n_tokens": own.sizes,
                "log_ppl": -np.add.reduceat(np.log(p), starts) / own.sizes, "worst": worst, "trusted": marks & (TRUSTED | FITTED) == TRUSTED,
            })

        found = of_docs.unionByName(of_pairs.where("bucket >= 0")).unionByName(of_words.where("bucket >= 0"))
        buckets = self.dealt.select("bucket", "bucketed", "docs").groupBy("bucket")
        #: bucket, place, doc_id, language, n_tokens (with the end), log_ppl, worst (see Model.judge) and trusted, without those fitted on.
        with _shuffles_dropped(spark):
            self.scored = materialize(buckets.cogroup(found.groupBy("bucket")).applyInArrow(meet, _SCORED), "perplexity")

    def kept(self, rejected: Column) -> DataFrame:
        """The rows of the documents that a condition on their scores doesn't reject: they lie in the buckets, so that no text is shuffled."""
        schema = self.schema

        def run(table: pa.Table, found: pa.Table) -> pa.Table:
            rows = _unpacked_rows(table.column("rows")[0].as_py())
            places = np.sort(found.column("place").to_numpy())
            return pa.table(rows.take(pa.array(places)).columns, names=schema.names)

        out = self.scored.where(~F.coalesce(rejected, F.lit(False))).select("bucket", "place")
        return self.dealt.select("bucket", "rows").groupBy("bucket").cogroup(out.groupBy("bucket")).applyInArrow(run, schema)


def _packed_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked_rows(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_all()


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """language, limit and worst (quantiles of log_ppl and worst), and n, the documents they come from; the row whose language is null is that of all.
    scored: documents with log_ppl, worst and trusted."""
    trusted = scored.where(F.col("trusted") & (F.col("n_tokens") > MIN_WORDS))
    found = F.percentile_approx("log_ppl", quantile, 10_000).alias("limit"), F.percentile_approx("worst", quantile, 10_000).alias("worst"), F.count("*").alias("n")
    own = trusted.where(F.col("language").isNotNull()).groupBy("language").agg(*found)
    return own.unionByName(trusted.agg(*found).select(F.lit(None).cast("string").alias("language"), "limit", "worst", "n"))


class Fitted:
    """The model of a table of documents and labels as one Model: fitted, and collected, only where it is asked for, which suits small tables. Scores don't need it."""

    def __init__(self, docs: DataFrame, marks: DataFrame, id_col: str, text_col: str):
        self._texts = keyed(docs, id_col, text_col).join(marks, "doc_id")

    @cached_property
    def _model(self) -> Model:
        model = fit(self._texts.where(F.col("mark").bitwiseAND(FITTED) > 0))
        model.toxic = fit_toxic(self._texts.where(F.col("mark").bitwiseAND(TOXIC) > 0))
        return model

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self._model, name)


def _judge(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_docs: int | None, quantile: float, rows: bool = False) -> tuple[Fitted, Scores, dict[str | None, tuple[float, float]]]:
    """The model, the scores of all documents, and the limits of log perplexity and of the worst word by language; the key None is
    those of the others."""
    good = trusted_ids(labels)
    fitted = good.where(F.pmod(F.hash("doc_id"), F.lit(HELD_OUT)) > 0)
    if max_docs is not None:
        fitted = fitted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    marks = [df.select("doc_id", F.lit(mark).alias("mark")) for df, mark in ((good, TRUSTED), (fitted, FITTED), (toxic_ids(labels), TOXIC))]
    marks = marks[0].unionByName(marks[1]).unionByName(marks[2]).groupBy("doc_id").agg(F.bit_or("mark").alias("mark"))
    scores = Scores(docs, marks, id_col, text_col, rows)
    found = {r.language: r for r in thresholds(scores.scored, quantile).collect() if r.limit is not None}
    unknown = math.log(scores.toxic.unknown / (scores.lower.unknown or 1.0)) if scores.toxic.unknown else math.inf  # an unknown word alone, or where no text is toxic, no word rejects
    relied = {k: (r,) if r.n >= FEW else (r, found[None]) for k, r in found.items()}
    return Fitted(docs, marks, id_col, text_col), scores, {k: (max(r.limit for r in rs), max(0.0, unknown, *(r.worst for r in rs))) for k, rs in relied.items()}


def _rejected(limits: dict[str | None, tuple[float, float]], margin: float) -> tuple[Column, Column]:
    """Whether a scored document is rejected, and its limit of log perplexity."""
    own = lambda at: F.coalesce(*(F.when(F.col("language") == k, F.lit(v[at])) for k, v in limits.items() if k is not None), F.lit(limits[None][at] if limits else None).cast("double"))
    return (F.col("n_tokens") > MIN_WORDS) & (F.col("log_ppl") > own(0) + math.log(margin)) | (F.col("worst") > own(1) + math.log(TOXIC_MARGIN)), own(0)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int | None = MAX_TRUSTED_DOCS, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """One row per document: doc_id, language, n_tokens, perplexity, limit and kept."""
    _, scores, limits = _judge(docs, labels, id_col, text_col, max_docs, quantile)
    rejected, limit = _rejected(limits, margin)
    return scores.scored.select("doc_id", "language", "n_tokens", F.exp("log_ppl").alias("perplexity"), F.exp(limit).alias("limit"), (~F.coalesce(rejected, F.lit(False))).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int | None = MAX_TRUSTED_DOCS, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns."""
    _, scores, limits = _judge(docs, labels, id_col, text_col, max_docs, quantile, True)
    return scores.kept(_rejected(limits, margin)[0])
