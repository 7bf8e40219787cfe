"""Fill-in-middle transformation by succinct rank and select.

A text is cut between tokens: a word with the blanks before it, or blanks at the end. The bytes of a batch of texts get a packed
bitvector that marks the last byte of each token, and one that marks the first byte of each code point; both have a directory of the ones before each block
of 512 bits. The ones between a text's ends are its number of tokens n; two ranks drawn from a hash of the id are turned into byte cuts by
select, and the code points of the parts are differences of ranks. Prefix, middle and suffix are then written in one of two
orders (psm, spm), or the text is left plain. Texts that hold a mark are left plain, so marks in an output are always cuts.

A null text is an empty text, which is plain with no tokens; a null id is hashed as an empty one. Texts of any length are cut whole, in chunks of
texts; rows that repeat get equal outputs; an empty table gives an empty result; other columns, whatever their names, are left out. Narrow: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.llm.shared import chunked, keyed

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
#: Of a hundred texts, those that are cut, and of a hundred of these, those that are written suffix first.
CUT_PERCENT, SPM_PERCENT = 50, 80
CHUNK_BYTES = 4 << 20
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_WORDS = 8  # 64-bit words in a block


class RankSelect:
    """A packed bitvector with the number of ones before each block of 512 bits; queries take arrays."""

    def __init__(self, bits: np.ndarray):
        blocks = len(bits) // (64 * _WORDS) + 1
        self.words = np.zeros(blocks * _WORDS, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.ones = np.bitwise_count(self.words).reshape(blocks, _WORDS)
        self.before = np.concatenate([[0], np.cumsum(self.ones.sum(1, dtype=np.int64))])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        i = np.asarray(i, np.int64)
        word, block = i >> 6, i >> 9
        whole = np.where(np.arange(_WORDS) < (word & (_WORDS - 1))[:, None], self.ones[block], 0).sum(1, dtype=np.int64)
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + whole + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one that has k ones before it."""
        k = np.asarray(k, np.int64)
        block = np.searchsorted(self.before, k, "right") - 1
        rest = k - self.before[block]
        seen = np.cumsum(self.ones[block], axis=1, dtype=np.int64)
        word = (seen <= rest[:, None]).sum(1)
        rest -= np.where(word > 0, np.take_along_axis(seen, np.maximum(word - 1, 0)[:, None], 1).ravel(), 0)
        bits = np.unpackbits(self.words[block * _WORDS + word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (block * _WORDS + word) * 64 + (np.cumsum(bits, axis=1, dtype=np.int64) <= rest[:, None]).sum(1)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and bytes of a column of strings, without a copy."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def token_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marks the last byte of each token of the texts that lie between the offsets at."""
    blank = _BLANK[data]
    ends = ~blank
    ends[:-1] &= blank[1:]
    ends[at[1:][at[1:] > at[:-1]] - 1] = True
    return ends


def cuts(data: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, both byte cuts, and the code points of prefix and middle, of each text; first and second are hashes."""
    tokens, points = RankSelect(token_ends(data, at)), RankSelect((data & 0xC0) != 0x80)
    ranks = tokens.rank(at)
    n = np.diff(ranks)
    a, b = first % (n + 1), second % (n + 1)
    places = [np.where(k > 0, tokens.select(np.where(k > 0, ranks[:-1] + k - 1, 0)) + 1, at[:-1]) if ranks[-1] else at[:-1] for k in (np.minimum(a, b), np.maximum(a, b))]
    upto = [points.rank(p) for p in (at[:-1], *places)]
    return n, *places, upto[1] - upto[0], upto[2] - upto[1]


def _hashes(ident: Column, seed: int) -> list[Column]:
    hex_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hex_, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per document: doc_id, n, form (plain, psm or spm), prefix_chars and middle_chars (null if plain), output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, data = _buffers(batch.column(1))
            h = [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5)]
            for low, high in chunked(np.diff(every).tolist(), CHUNK_BYTES):
                own, at = data[every[low] : every[high]], every[low : high + 1] - every[low]
                n, one, two, prefix, middle = cuts(own, at, h[0][low:high], h[1][low:high])
                forms, outputs, raw = [], [], own.tobytes()
                drawn = (h[2][low:high] % 100 < cut_percent).tolist()
                spm = (h[3][low:high] % 100 < spm_percent).tolist()
                for k, (s, p, q, e) in enumerate(zip(at[:-1].tolist(), one.tolist(), two.tolist(), at[1:].tolist(), strict=True)):
                    text = raw[s:e]
                    if not text or not drawn[k] or PREFIX in text or SUFFIX in text or MIDDLE in text:
                        forms.append("plain")
                        outputs.append(text)
                    elif spm[k]:
                        forms.append("spm")
                        outputs.append(b"".join((SUFFIX, raw[q:e], PREFIX, raw[s:p], MIDDLE, raw[p:q])))
                    else:
                        forms.append("psm")
                        outputs.append(b"".join((PREFIX, raw[s:p], SUFFIX, raw[q:e], MIDDLE, raw[p:q])))
                plain = np.array([f == "plain" for f in forms])
                columns = [batch.column(0).slice(low, high - low), pa.array(n), pa.array(forms, pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(outputs, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    df = keyed(docs, id_col, text_col).select("doc_id", "text", *_hashes(F.col("doc_id"), seed))
    return df.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: its parts between the marks, in order."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
