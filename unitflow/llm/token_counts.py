"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its words, each after the mark U+2581. Distinct pre-tokens go into a trie; a node's
forward score, the best log probability of any split of its prefix into pieces, is computed once however many
pre-tokens share the prefix, and the node where a pre-token ends keeps its count of pieces. Of equal scores the
split with fewer pieces counts. A piece's probability follows its rank in the vocabulary by Zipf's law; characters in no piece
cost a piece for each of their bytes.

A word longer than MAX_WORD is scored by the same recurrence without nodes, keeping only as many scores as the longest piece needs.
A null or empty text has no tokens. Rows that repeat are counted each; ids may be null; an empty table gives an empty
result. Narrow: no shuffle; memory is bounded by one chunk of text, the trie and the cache.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from unitflow.llm.shared import chunked, keyed, words_of

MARK = "▁"
#: Nodes and pre-tokens after which a worker starts anew, so that its memory has a bound.
MAX_NODES = 600_000
MAX_KEPT = 500_000
CHUNK_CHARS = 1 << 20
#: Characters of the longest word that gets nodes.
MAX_WORD = 10_000


class UnigramTrie:
    """A trie whose nodes hold forward scores."""

    def __init__(self, pieces: dict[str, float], byte_score: float):
        self.pieces, self.byte_score = pieces, byte_score
        self.longest = max(map(len, pieces), default=1)
        self.endings = {p[-1]: set() for p in pieces}
        for p in pieces:
            self.endings[p[-1]].add(len(p))
        self.endings = {c: sorted(n) for c, n in self.endings.items()}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def alone(self, word: str) -> tuple[int, float]:
        """Like insert(), for a word of any length: without nodes, in memory that its length does not change."""
        scores = deque([(0.0, 0)], self.longest)  # of the prefixes before this character, the last one last
        for d, c in enumerate(word, 1):
            n_bytes = len(c.encode())
            top, least = scores[-1][0] + n_bytes * self.byte_score, scores[-1][1] + n_bytes
            for n in self.endings.get(c, ()):
                if n > d:
                    break
                own = self.pieces.get(word[d - n : d])
                if own is not None:
                    total, count = scores[-n][0] + own, scores[-n][1] + 1
                    if total > top or total == top and count < least:
                        top, least = total, count
            scores.append((top, least))
        return scores[-1][1], scores[-1][0]

    def insert(self, word: str) -> tuple[int, float]:
        """Pieces and log probability of the best split of a pre-token."""
        path, node = [0], 0
        best, count, child, pieces = self.best, self.count, self.child, self.pieces
        for d, c in enumerate(word, 1):
            key = node * 0x110000 + ord(c)
            node = child.get(key)
            if node is None:
                n_bytes = len(c.encode())
                at = path[d - 1]
                top, least = best[at] + n_bytes * self.byte_score, count[at] + n_bytes
                for n in self.endings.get(c, ()):
                    if n > d:
                        break
                    own = pieces.get(word[d - n : d])
                    if own is not None:
                        at = path[d - n]
                        total = best[at] + own
                        if total > top or total == top and count[at] + 1 < least:
                            top, least = total, count[at] + 1
                node = child[key] = len(best)
                best.append(top)
                count.append(least)
            path.append(node)
        return count[node], best[node]


@lru_cache(2)
def zipf_pieces(path: str) -> tuple[dict[str, float], float]:
    """Pieces with log probabilities by rank, and that of a byte, from a SentencePiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    total = math.log(sum(1 / (k + 1) for k in range(size)))
    plain = [model.id_to_piece(k) for k in range(size) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
    return {p: -math.log(k + 1) - total for k, p in enumerate(plain)}, -math.log(size) - total


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens and log_prob, the score of the best splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, kept = UnigramTrie(*zipf_pieces(vocabulary)), {}
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            rows = []
            for low, high in chunked([len(t) for t in texts], CHUNK_CHARS):
                listed = [words_of(t) for t in texts[low:high]]
                missing = {w for words in listed for w in words if w not in kept}
                if len(kept) + len(missing) > MAX_KEPT:
                    kept.clear()
                    missing = {w for words in listed for w in words}
                for w in sorted(missing):
                    if len(trie.best) > MAX_NODES:
                        trie.clear()
                    own = MARK + w.decode()
                    kept[w] = trie.insert(own) if len(own) <= MAX_WORD else trie.alone(own)
                for words in listed:
                    found = [kept[w] for w in words]
                    rows.append((len(words), sum(n for n, _ in found), math.fsum(s for _, s in found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()), strict=True))], names=["doc_id", "n_words", "n_tokens", "log_prob"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long, log_prob double")
