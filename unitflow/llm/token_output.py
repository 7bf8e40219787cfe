"""Token ids in files of directly addressable codes.

Ids are split into chunks of eight bits. The first level holds the lowest chunk of every id and a bitmap that says
which ids continue; the next level holds the next chunk of those only, and so on. A directory of ranks over each
bitmap finds an id's chunk on the next level, so any token is read without decoding what stands before it.

Documents are ordered by id (null ids first, equal ids by a hash of their texts) over ranges that Spark samples, and each task cuts its range into
files of a bounded number of bytes, so neither the number of tasks nor a file's size depends on a fixed count; a text longer than a file
is a file of its own. A file has a directory of its documents. Files are rows of a Parquet table below the shared folder, so any executor can read them.
A null text is an empty text, which has its end id alone. Rows that repeat are written each, and are dealt to several tasks if they are many; an empty table gives no files.
"""

from __future__ import annotations

import json
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitflow.llm.shared import chunked, keyed, materialize, shuffle_partitions
from unitflow.operators.numbering import sums_before

MAGIC = b"DACF1\0\0\0"
RANK_BITS = 512
MAX_KEPT = 1_500_000
CHUNK_CHARS, LINE_BYTES = 1 << 20, 1 << 14
#: Text that one task encodes, and packed ids after which it begins another file.
TASK_BYTES, FILE_BYTES = 32 << 20, 8 << 20
_SPACED = bytes(32 if c == 10 else c for c in range(256))
_LOWERED = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 10 else c for c in range(256))
_POINTS = b".,;:!?#*$%&|<>()"
#: A pre-tokenizer that parts letters, digits and all else, and no run of these.
_PARTS_ENDS = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Files whose offsets are sent to the executors: 16 bytes each.
SENT_FILES = 1 << 18
#: Bytes of a part that is kept.
LONGEST = 256
NO_ID = np.iinfo(np.int64).min


def pack(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, continuation bitmap, rank directory) of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, np.int64)
        levels.append(((rest & 0xFF).astype(np.uint8), bits, np.concatenate([[0], np.cumsum(ones)]).astype("<u4")))
        if not more.any():
            return levels
        rest = rest[more] >> 8


class DacFile:
    """Reads the bytes of one file, whole or at any place."""

    def __init__(self, data: bytes):
        magic, self.n_docs, self.n_tokens, n_levels = struct.unpack_from("<8sQQQ", data)
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at = 32
        take = lambda kind, n: np.frombuffer(data, kind, n, at)
        self.doc_ids = take("<i8", self.n_docs)
        at += 8 * self.n_docs
        self.starts = take("<u8", self.n_docs + 1)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = take(np.uint8, n)
            at += n
            bits = take(np.uint8, -(-n // 8))
            at += -(-n // 8)
            ranks = take("<u4", -(-n // RANK_BITS) + 1)
            at += 4 * (-(-n // RANK_BITS) + 1)
            self.levels.append((chunks, bits, ranks))

    def token(self, i: int) -> int:
        """The id at a place, from one chunk of each level it has."""
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            inside = np.unpackbits(bits[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i = int(ranks[block]) + int(inside.sum())
        return value

    def all_tokens(self) -> np.ndarray:
        out, places = np.zeros(self.n_tokens, dtype="<u4"), None
        for k, (chunks, bits, _) in enumerate(self.levels):
            value = chunks.astype(np.uint32) << np.uint32(8 * k)
            if places is None:
                out[:] = value
                places = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            else:
                out[places] |= value
                places = places[np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))]
        return out


def file_bytes(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    levels = pack(ids)
    parts = [struct.pack("<8sQQQ", MAGIC, len(doc_ids), len(ids), len(levels)), doc_ids.astype("<i8").tobytes(), np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes()]
    for chunks, bits, ranks in levels:
        parts += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(parts)


def _parts(text: bytes, lowers: bool) -> list[bytes]:
    """What stands between spaces and line feeds, A-Z in lower case if the vocabulary's normalizer lowers letters anyway; a text with the
    mark of special tokens keeps its capitals, as those are told apart before."""
    return text.translate(_LOWERED if lowers and b"<|" not in text else _SPACED).split(b" ")


def _ended(part: bytes) -> tuple[bytes, bytes]:
    """A part and the points at its end, if it is long enough and the pre-tokenizer parts the two: after a letter or a digit, which no mark that
    follows could change."""
    word = part.rstrip(_POINTS)
    if len(word) == len(part) or not word or b"<|" in part or not (word[-1:].isalnum() or word.decode()[-1].lower()[-1].isalpha()):
        return part, b""
    return word, part[len(word) :]


def _is_word(part: bytes) -> bool:
    """Whether a part is letters of Latin alone, before and after it is lowered: one pre-token."""
    if part.isascii():
        return part.isalpha()
    text = part.decode()
    return text.isalpha() and max(text) < "\u0250" and text.lower().isalpha()


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def _kept(path: str, run: str) -> dict[bytes, bytes]:
    """A worker's cache of encoded parts, which its later tasks of the same run go on with; another run begins with an empty one."""
    return {}


class Encoder:
    """Packed ids of texts, the end id last.

    The vocabulary's pre-tokenizer never crosses a space or a line feed, and normalising is local to what lies between them: a worker
    encodes each such part once while its cache holds it. Where the pre-tokenizer also parts letters from points, a word and the points at its end are
    encoded apart, so that a word is encoded once for all its endings.
    """

    def __init__(self, vocabulary: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        self.vocabulary, self.run = vocabulary, uuid.uuid4().hex
        own = _tokenizer(vocabulary)
        self.width = 4 if own.get_vocab_size() > 1 << 16 else 2
        self.kind = "I" if self.width == 4 else "H"
        self.lowers = '"Lowercase"' in json.dumps(json.loads(own.to_str())["normalizer"])
        self.ends = _PARTS_ENDS in json.loads(own.to_str())["pre_tokenizer"].get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex", "")
        suffix = json.loads(own.to_str())["model"].get("end_of_word_suffix")
        named = [own.id_to_token(i) or "" for i in range(own.get_vocab_size())] if suffix and self.ends else []
        self.stops = np.array([t.endswith(suffix) for t in named]) if named else None
        self.last = array(self.kind, [end_id]).tobytes()

    def _lines(self, words: list[bytes]) -> Iterator[bytes]:
        """The ids of words that are each one pre-token: words are encoded in lines, whose ids are parted after those that end a word."""
        own, at = _tokenizer(self.vocabulary), list(chunked([len(w) for w in words], LINE_BYTES))
        for (low, high), e in zip(at, own.encode_batch_fast([b" ".join(words[low:high]).decode() for low, high in at], add_special_tokens=False), strict=True):
            stops = np.flatnonzero(self.stops[e.ids]) + 1
            if len(stops) != high - low:  # not so after all
                yield from (array(self.kind, x.ids).tobytes() for x in own.encode_batch_fast([w.decode() for w in words[low:high]], add_special_tokens=False))
                continue
            line, stops = array(self.kind, e.ids).tobytes(), (stops * self.width).tolist()
            yield from map(line.__getitem__, map(slice, [0, *stops[:-1]], stops))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        own, kept = _tokenizer(self.vocabulary), _kept(self.vocabulary, self.run)
        for low, high in chunked([len(t) for t in texts], CHUNK_CHARS):
            listed = [_parts(t.encode(), self.lowers) for t in texts[low:high]]
            missing = set().union(*listed)
            if len(kept) + len(missing) > MAX_KEPT:
                kept.clear()
            new = missing.difference(kept)
            ended = {w: pair for w in new if (pair := _ended(w))[1]} if self.ends else {}
            whole = list((new.difference(ended) | {x for pair in ended.values() for x in pair}).difference(kept))
            words = [w for w in whole if _is_word(w)] if self.stops is not None else []
            kept.update(zip(words, self._lines(words), strict=True))
            rest = [w for w in whole if w not in kept]
            for w, e in zip(rest, own.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
                kept[w] = array(self.kind, e.ids).tobytes()
            for w, (word, points) in ended.items():
                kept[w] = kept[word] + kept[points]
            for parts in listed:
                yield b"".join(map(kept.__getitem__, parts)) + self.last
            for w in [w for w in new if len(w) > LONGEST]:
                kept.pop(w, None)
            for w in [w for w in whole if len(w) > LONGEST]:
                kept.pop(w, None)


def encode(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian uint32 or, where the vocabulary fits, uint16; the end id last) and width, the bytes of an id."""
    own = Encoder(vocabulary, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.encode(texts), pa.binary())], names=["doc_id", "ids"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary").withColumn("width", F.lit(own.width))


def output(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = TASK_BYTES, file_bytes_: int = FILE_BYTES) -> DataFrame:
    """Encodes, writes the files, and returns them: file, n_docs, n_tokens and data, in order of file.

    Texts are shuffled once, to the ranges that are encoded and written where they arrive.
    """
    df = keyed(docs, id_col, text_col)
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-total // task_bytes), min(shuffle_partitions(docs.sparkSession), total >> 20), 1)
    order = ["doc_id", "hash", "row"]  # the row's number deals rows that repeat
    df = df.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    own = Encoder(vocabulary, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packed, size, file = [], [], 0, TaskContext.get().partitionId() << 32

        def written() -> pa.RecordBatch:
            counts = np.array([len(x) // own.width for x in packed])
            data = file_bytes(np.array(ids, np.int64), counts, np.frombuffer(b"".join(packed), f"<u{own.width}"))
            return pa.RecordBatch.from_pydict({"file": [file], "n_docs": [len(ids)], "n_tokens": [int(counts.sum())], "data": pa.array([data], pa.binary())})

        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for i, x in zip(batch.column(0).to_pylist(), own.encode(texts), strict=True):
                if packed and size + len(x) > file_bytes_:
                    yield written()
                    ids, packed, size, file = [], [], 0, file + 1
                ids.append(NO_ID if i is None else i)
                packed.append(x)
                size += len(x)
        if packed:
            yield written()

    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialize(dealt.mapInArrow(run, "file long, n_docs long, n_tokens long, data binary"), "token-files")


def read_back(files: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids (binary, little-endian uint32).

    The offsets of files are running sums by levels, of the files of a task and of the tasks: one short row for each file, for megabytes of
    tokens. They are sent to the executors if they are few, and joined by a shuffle if not.
    """
    task = F.shiftright("file", 32).cast("int").alias("task")
    own = files.select("file", "n_tokens", task)
    tasks = own.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    n_files, top = own.agg(F.count("*"), F.max("task")).first()
    tasks = sums_before(tasks, "task", "n", top or 0).drop("n")
    inside = Window.partitionBy("task").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(tasks, "task").select("file", (F.col("before") + F.col("inside")).alias("offset"))
    sums = F.broadcast(sums) if n_files <= SENT_FILES else sums

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own, offset = DacFile(batch.column(0)[k].as_py()), batch.column(1)[k].as_py()
                tokens, starts = own.all_tokens(), own.starts.astype(np.int64)
                for low, high in chunked(np.diff(starts).tolist(), 1 << 20):
                    ids = [tokens[starts[i] : starts[i + 1]].tobytes() for i in range(low, high)]
                    named = own.doc_ids[low:high]
                    yield pa.RecordBatch.from_arrays([pa.array(named, pa.int64(), mask=named == NO_ID), pa.array(starts[low:high] + offset, pa.int64()), pa.array(np.diff(starts[low : high + 1]), pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return files.join(sums, "file").select("data", "offset").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")
