"""Near-duplicate detection by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set: its shingles of five lower-case words, each weighing its count times an inverse document frequency
that is 1 for shingles in up to a twentieth of the documents and falls slowly to 0.7 for those in most. Consistent
samples of these sets collide with the probability of the weighted Jaccard similarity. Samples are banded. Of texts that share a band, every
pair not yet in one class is compared: first by total weight and samples, which rule out what cannot be similar, then by
the weighted Jaccard similarity of the whole texts, and pairs of 0.8 or more are linked. Linked texts form classes.

Equal texts are one node, named by a 128-bit hash of the text, so copies are never expanded into pairs; nor are the pairs of a band, which
meet inside tasks, in blocks of bounded size where a band is large. A text of fewer words than a shingle is one
shingle; one without words (null included) equals only its exact copies. Texts of any length are compared whole. Rows that repeat share a class; ids may be null and are
then passed over as names of classes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.llm.shared import chunked, free_name, materialize, words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
#: A shingle is frequent if more than one in FREQUENT documents holds it; at most FREQUENT times the mean number of shingles of a text are.
FREQUENT = 20
LEAST_IDF = 0.7
#: Shingles are counted in groups of documents; a group reports those in more than one of REPORTED of its documents.
REPORTED = 100
#: Copies of one text count once towards document frequencies if they are more than one in COPIES documents: at most COPIES such texts.
COPIES = 1000
CHUNK_CHARS, CHUNK_DOCS = 1 << 20, 500
CELLS = 1 << 15
CELL_BITS = 20
#: Of 64 samples of two texts of similarity 0.8, fewer than this many agree once in 2,000,000 times.
LEAST_AGREEING = 34
#: Texts, and words of texts, of a band that meet in one task: a larger band is dealt into blocks, and each two of these meet.
BLOCK_ROWS, BLOCK_WORDS = 1 << 14, 4_000_000
#: Partners of a band's first text that are compared with it in one task.
HUB_ROWS = 2048


def _mixed(n: int, seed: int) -> np.ndarray:
    z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31)) | np.uint64(1)


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 65,536 equal steps, by bisection of 1 - (1 + x) e^-x."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros_like(u), np.full_like(u, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return mid


GAMMA = _gamma_quantiles().astype(np.float32)
LOG_GAMMA = np.log(_gamma_quantiles()).astype(np.float32)
PLACES = _mixed(SHINGLE, 7)


class Shingler:
    """Weighted shingles of texts. Words are hashed anew each time, which takes half as long as looking them up among many."""

    def __init__(self, frequent: tuple[np.ndarray, np.ndarray] | None = None):
        self.keys, self.idf = frequent if frequent is not None else (np.zeros(0, np.uint64), np.zeros(0))

    def hashes(self, text: str | None) -> np.ndarray:
        """Hashes of a text's shingles in order, repeats included."""
        words = words_of(text.lower()) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        n = max(len(own) - SHINGLE + 1, 1)
        h = np.zeros(n, np.uint64)
        for j in range(min(SHINGLE, len(own))):
            h += own[j : j + n] * PLACES[j]
            h ^= h >> np.uint64(29)
        return h

    def shingles(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of a text's shingles, and their counts."""
        return np.unique(self.hashes(text), return_counts=True)

    def weights(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = counts.astype(float)
        if len(self.keys) and len(hashes):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            out *= np.where(self.keys[at] == hashes, self.idf[at], 1.0)
        return out

    def similarity(self, one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
        """Weighted Jaccard similarity of two (hashes, weights)."""
        _, at, to = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
        both = np.minimum(one[1][at], two[1][to]).sum()
        total = one[1].sum() + two[1].sum() - both
        return float(both / total) if total else 0.0

    def weighted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        hashes, counts = self.shingles(text)
        return hashes, self.weights(hashes, counts)


def samples(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """n consistent weighted samples of each set; the sets are the runs of hashes that begin at starts."""
    out = np.empty((len(starts), n), np.int64)
    other = np.flatnonzero(weights != 1.0)
    log_w = np.log(weights[other]).astype(np.float32)
    for k, salt in enumerate(_mixed(n, 11)):
        z = (hashes ^ salt) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xD6E8FEB86659FD93)
        parts = z.view(np.uint16).reshape(-1, 4)
        beta = parts[:, 1].astype(np.float32) * np.float32(1 / 65536)
        r = GAMMA[parts[:, 2]]
        log_c = LOG_GAMMA[parts[:, 3]]
        log_a = log_c - r * (1 - beta)  # for weight 1 the step t is 0
        name = z.astype(np.uint32)
        if len(other):
            t = np.floor(log_w / r[other] + beta[other])
            log_a[other] = log_c[other] - r[other] * (t - beta[other] + 1)
            name[other] ^= t.astype(np.int64).astype(np.uint32) * np.uint32(0x9E3779B1)
        bits = log_a.view(np.int32)
        order = bits ^ ((bits >> 31) & 0x7FFFFFFF)
        out[:, k] = np.minimum.reduceat(order.astype(np.int64) << 32 | name, starts)
    return out


def band_keys(drawn: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(drawn), BANDS), np.uint64)
    for j, m in enumerate(_mixed(ROWS, 13)):
        keys += drawn[:, j::ROWS].astype(np.uint64) * m
        keys ^= keys >> np.uint64(29)
    return keys.astype(np.int64)


def sketches(drawn: np.ndarray, keys: np.ndarray) -> list[bytes]:
    """A byte of each sample (unequal bytes are unequal samples), then the keys of all bands."""
    return [row.tobytes() for row in np.concatenate([drawn.astype(np.uint8), keys.astype("<i8").view(np.uint8)], axis=1)]


def _grouped(weights: dict[bytes, float], batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, float]]]:
    """(text, weight) in groups of CHUNK_DOCS or more, or of enough characters; the last is joined to the one before it."""
    held, now, chars = [], [], 0
    for batch in batches:
        for text, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            now.append((text, weights.get(node, 1.0)))
            chars += len(text or "")
            if len(now) >= CHUNK_DOCS and chars >= 4 * CHUNK_CHARS or chars >= 8 * CHUNK_CHARS:
                if held:
                    yield held
                held, now, chars = now, [], 0
    if held or now:
        yield held + now


def _reported(group: list[tuple[str, float]], shingler: Shingler) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that may be in more than one of REPORTED texts of a group, with at least the number of texts they are in. Repeats within a text
    count too; those of a cell of hashes that is too light all together are ruled out before anything is sorted."""
    found = [shingler.hashes(t) for t, _ in group]
    every, own = np.concatenate(found), np.repeat([w for _, w in group], [len(h) for h in found])
    least = sum(w for _, w in group) / REPORTED
    cell = (every >> np.uint64(64 - CELL_BITS)).astype(np.int64)
    heavy = (np.bincount(cell, own, 1 << CELL_BITS) > least)[cell]
    keys, at = np.unique(every[heavy], return_inverse=True)
    sums = np.bincount(at, own[heavy], len(keys))
    return keys[sums > least], sums[sums > least]


def frequent_shingles(texts: DataFrame, copies: dict[bytes, float], n: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in more than one of FREQUENT documents, with their idf. texts: text and node.

    A first pass sums what groups of documents report, which falls short of a shingle's documents by one in REPORTED at most; those whose sum
    may be frequent are counted exactly by a second pass. They are at most 1 / (1 / FREQUENT - 1 / REPORTED) = 25 times the mean
    number of shingles of a text, however many texts there are; so they are collected and sent. Reports are summed by a shuffle.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for group in _grouped(copies, batches):
            keys, sums = _reported(group, shingler)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sums)], names=["shingle", "df"])

    total = lambda df: df.groupBy("shingle").agg(F.sum("df").alias("df"))
    few = total(texts.mapInArrow(report, "shingle long, df double")).where(F.col("df") > n / FREQUENT - n / REPORTED)
    keys = np.sort(few.select("shingle").toPandas()["shingle"].to_numpy(np.int64).astype(np.uint64))
    if not len(keys):
        return np.zeros(0, np.uint64), np.zeros(0)
    sent = texts.sparkSession.sparkContext.broadcast(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, keys = Shingler(), sent.value
        sums = np.zeros(len(keys))
        for batch in batches:
            for text, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shingler.hashes(text)
                if len(own):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    sums[np.unique(at[keys[at] == own])] += copies.get(node, 1.0)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys[at].astype(np.int64)), pa.array(sums[at])], names=["shingle", "df"])

    found = total(texts.mapInArrow(count, "shingle long, df double")).where(F.col("df") > n / FREQUENT).toPandas()
    keys, df = found["shingle"].to_numpy(np.int64).astype(np.uint64), found["df"].to_numpy(float)
    order = np.argsort(keys)
    idf = np.clip(np.log(n / df) / np.log(FREQUENT), LEAST_IDF, 1.0).round(6)
    return keys[order], idf[order]


def _signatures(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, node, total (the weight of all shingles), and the keys of the bands and the sketch of the samples, null for texts without words."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(sent.value)
        for batch in batches:
            strings = batch.column(0).to_pylist()
            keys, marks, total = [None] * len(strings), [None] * len(strings), np.zeros(len(strings))
            for low, high in chunked([len(t or "") for t in strings], CELLS * 6):
                sets = [shingler.weighted(t) for t in strings[low:high]]
                rows = [i for i, (h, _) in enumerate(sets) if len(h)]
                if not rows:
                    continue
                sizes = [len(sets[i][0]) for i in rows]
                drawn = samples(np.concatenate([sets[i][0] for i in rows]), np.concatenate([sets[i][1] for i in rows]), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64))
                names = band_keys(drawn)
                for i, own, mark in zip(rows, names.tolist(), sketches(drawn, names), strict=True):
                    keys[low + i], marks[low + i], total[low + i] = own, mark, sets[i][1].sum()
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(total), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=["doc_id", "node", "total", "bands", "sketch"])

    return texts.mapInArrow(run, "doc_id long, node binary, total double, bands array<long>, sketch binary")


def _shared_bands(nodes: DataFrame) -> DataFrame:
    """band, key, node, n and words (rows and summed weights of the band) of the nodes of each band that two or more share."""
    rows = nodes.where(F.col("bands").isNotNull()).select("node", "total", F.posexplode("bands").alias("band", "key"))
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("total").alias("words")).where("n > 1")
    return rows.join(sizes, ["band", "key"]).select("band", "key", "node", "n", "words")


def _with_hubs(pairs: DataFrame, texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is threshold or more; each b is in one pair, an a in any number.

    An a with many partners is sent to several tasks, one for each HUB_ROWS of these; it comes first there, and its partners stream past.
    """
    sent = pairs.sparkSession.sparkContext.broadcast(frequent)
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("salts"))
    own = texts.select(F.col("node").alias("b"), "text")
    members = pairs.join(salts, "a").join(own, "b").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "text")
    hubs = salts.join(texts.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("b"), "text")
    rows = hubs.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, hub = Shingler(sent.value), None
        for batch in batches:
            out = []
            for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = shingler.weighted(batch.column(3)[k].as_py())
                if b is None:
                    hub = own
                elif shingler.similarity(hub, own) >= threshold:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], names=["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, the first n_keys columns; a run is held whole."""
    held, last = [], None
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
        start = 0
        for k in range(len(keys) + 1):
            if k == len(keys) or keys[k] != (keys[k - 1] if k else last):
                if k > start:
                    held.append(batch.slice(start, k - start))
                if k < len(keys) and held:
                    yield pa.Table.from_batches(held)
                    held = []
                start = k
        last = keys[-1] if keys else last
    if held:
        yield pa.Table.from_batches(held)


class Block:
    """Rows of one band that meet in a task, in order of their total weights."""

    def __init__(self, table: pa.Table, threshold: float):
        total = table.column("total").to_numpy()
        self.order = np.argsort(total, kind="stable")
        self.total = total[self.order]
        marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(total), -1)[self.order]
        self.marks, self.keys = marks[:, : BANDS * ROWS], np.ascontiguousarray(marks[:, BANDS * ROWS :]).view("<i8")
        names = table.column("label").to_pylist()
        codes = {x: k for k, x in enumerate(dict.fromkeys(names))}
        self.label = np.array([codes[x] for x in names])[self.order]
        self.own = table.column("own").to_numpy()[self.order]
        self.band, self.crosses = table.column("band")[0].as_py(), table.column("one")[0].as_py() != table.column("two")[0].as_py()
        self.stop = np.searchsorted(self.total, self.total / threshold * (1 + 1e-9), "right")

    def partners(self, i: int) -> np.ndarray:
        """Places after i that may be similar to it: of another label, total weights near enough, enough samples that agree, and this band
        the first that the two share."""
        rest = slice(i + 1, int(self.stop[i]))
        may = self.label[rest] != self.label[i]
        if self.crosses:
            may &= self.own[rest] != self.own[i]
        at = np.flatnonzero(may)
        at = at[(self.marks[rest][at] == self.marks[i]).sum(1) >= LEAST_AGREEING] + i + 1
        return at[(self.keys[at] == self.keys[i]).argmax(1) == self.band]


_BLOCK = "band int, key long, one int, two int, own int, node binary, label binary, total double, sketch binary"


def _within_bands(shared: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """Links (a, b) between nodes of different labels that share a band: all that join labels, but no more than join these inside a task.

    Bands whose nodes have one label are done. The others meet by sketches; only texts that have a possible partner are sent,
    and compared whole. A band of more than BLOCK_ROWS texts or BLOCK_WORDS words is dealt into blocks, and every two blocks meet in a task.
    """
    sent = shared.sparkSession.sparkContext.broadcast(frequent)
    named = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band", "key")
    rows = named.join(mixed, ["band", "key"], "left_semi").join(nodes.select("node", "total", "sketch"), "node")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("words") / BLOCK_WORDS)).cast("int")
    rows = rows.select("*", blocks.alias("blocks")).select("*", F.pmod(F.xxhash64("key", "node"), F.col("blocks")).cast("int").alias("own"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    rows = rows.select("band", "key", F.least("own", "k").alias("one"), F.greatest("own", "k").alias("two"), "own", "node", "label", "total", "sketch")
    dealt = lambda df: df.repartition("band", "key", "one", "two").sortWithinPartitions("band", "key", "one", "two")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 4):
            block, found = Block(table, threshold), set()
            for i in range(len(block.total)):
                if len(js := block.partners(i)):
                    found.update([i, *js.tolist()])
            if found:
                yield from table.take(pa.array(sorted(block.order[sorted(found)].tolist()))).combine_chunks().to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(sent.value)
        for table in _runs(batches, 4):
            block, sets, out, top = Block(table, threshold), {}, [], {}
            texts = table.column("text")

            def of(i: int):
                if i not in sets:
                    sets[i] = shingler.weighted(texts[int(block.order[i])].as_py())
                return sets[i]

            def root(x: int) -> int:
                while x in top:
                    x = top[x]
                return x

            for i in range(len(block.total)):
                for j in block.partners(i).tolist():
                    a, b = root(int(block.label[i])), root(int(block.label[j]))
                    if a != b and shingler.similarity(of(i), of(j)) >= threshold:
                        top[a] = b
                        out.append((i, j))
            if out:
                node = table.column("node")
                yield pa.RecordBatch.from_arrays([pa.array([node[int(block.order[p[k]])].as_py() for p in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    met = materialize(dealt(rows).mapInArrow(possible, _BLOCK), "possible-partners")
    return dealt(met.join(texts, "node").select(*met.columns, "text")).mapInArrow(compare, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node and label, the least node it is linked to, for every node of links (a, b); by alternating large and small stars.

    Each round joins and groups by node and is written to the shared folder; rounds grow with the logarithm of a component's size.
    """
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = materialize(small, "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
        before = now


def _hashed(text: Column) -> Column:
    return F.unhex(F.md5(text))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, node (the hash of its text), label (the least node of its class) and class_id, the
    least doc_id of its class. Where ids repeat, two classes may share a class_id; labels tell them apart.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"), _hashed(text).alias("node"), F.col(id_col).cast("long").alias("doc_id"))
    counted = texts.groupBy("node").agg(F.count("*").alias("n"))
    n = texts.count()
    copies = {bytes(r.node): 1.0 / r.n for r in counted.where(F.col("n") > max(n / COPIES, 1)).collect()}  # at most COPIES rows
    frequent = frequent_shingles(texts.select("text", "node"), copies, n - sum(1 / w - 1 for w in copies.values()))
    signed = materialize(_signatures(texts, frequent), "signatures")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.first("total").alias("total"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    shared = materialize(_shared_bands(nodes.select("node", "total", "bands")), "shared-bands")
    owners = nodes.select("node", "first_doc").join(shared.select("node").distinct(), "node")
    found = texts.join(owners, (texts.node == owners.node) & texts.doc_id.eqNullSafe(owners.first_doc)).select(owners.node, "text")
    candidates = materialize(found.dropDuplicates(["node"]), "candidate-texts")
    # First each node with the least node of its bands; then all pairs of a band that are not in one class by that.
    least = shared.join(shared.groupBy("band", "key").agg(F.min("node").alias("hub")), ["band", "key"])
    hubs = materialize(least.where("hub <> node").groupBy(F.col("node").alias("b")).agg(F.min("hub").alias("a")).select("a", "b"), "hub-pairs")
    labels = materialize(components(_with_hubs(hubs, candidates, frequent, threshold)), "labels")
    links = _within_bands(shared, labels, nodes, candidates, frequent, threshold)
    for side in ("a", "b"):
        own = labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
        links = links.join(own, side, "left").withColumn(side, F.coalesce(f"label_{side}", side)).drop(f"label_{side}")
    joined = components(links).select(F.col("node").alias("label"), F.col("label").alias("top"))
    named = nodes.select("node", "first_doc").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.join(joined, "label", "left").select("node", "first_doc", F.coalesce("top", "label").alias("label"))
    least = named.groupBy("label").agg(F.min("first_doc").alias("class_id"))
    owned = named.join(least, "label").select("node", "label", "class_id")
    return signed.select("doc_id", "node").join(owned, "node").select("doc_id", "node", "label", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all its columns: the one of least doc_id, and of equal ids the text of least hash."""
    found = materialize(classes(docs, id_col, text_col, threshold), "classes")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("w"), F.count("*").alias("n")).select("w.doc_id", "w.node")
    hash_, doc, node = (free_name(docs, f"__{n}") for n in ("hash", "doc", "node"))
    stay = first.select(F.col("doc_id").alias(doc), F.col("node").alias(node))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    kept = docs.withColumn(hash_, _hashed(text)).join(stay, (F.col(hash_) == F.col(node)) & docs[id_col].cast("long").eqNullSafe(F.col(doc)), "left_semi")
    if not found.groupBy("doc_id", "node").count().where("count > 1").isEmpty():  # rows that repeat
        kept = kept.dropDuplicates([id_col, hash_])
    return kept.drop(hash_)
