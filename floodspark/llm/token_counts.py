"""Operator 2 - token counts by trie-shared dynamic programming.

The tokenizer is a unigram model: a pre-token is cut into the pieces of a fixed vocabulary with the
highest total score; a character outside the vocabulary costs one byte piece per UTF-8 byte. The best
score of a prefix does not depend on what follows it, so the distinct pre-tokens of a slice of texts are
put in a trie and every node (prefix) is scored once, however many pre-tokens share it; terminal nodes
keep their token count and score, and documents sum over their words.

The trie is built in depth-first order, that is from the sorted pre-tokens: only the nodes on the path
to the present one are held, each with the forward score of its prefix. The pieces that end at a node
are found by walking a trie of the reversed vocabulary from the node towards the root, which visits
existing pieces only and stops where none goes on.

Scores are whole numbers (see ``unigram``), so ties and sums are exact: of equal scores the
segmentation with fewer pieces wins.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released
from .packing import Known, vocabulary
from .text import Words, flat, slices

BYTE_SCORE = -16_000                      # of one byte of a character outside the vocabulary
SLICE_BYTES = 4_000_000
_ONE = 1 << 40                            # a node's value: score * _ONE - pieces, so that the greater is the better


@lru_cache(maxsize=2)
def unigram(path: str) -> dict[str, int]:
    """piece -> score: -1000 ln(rank + 2) by the piece's place in the vocabulary file, rounded.
    Pieces of letters only; the word-begin mark is a blank that every pre-token starts with."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    return {p: -round(1000 * math.log(rank + 2)) for rank, p in enumerate(pieces)}


@lru_cache(maxsize=2)
def backward(path: str) -> dict:
    """The vocabulary's trie from the last character to the first: character -> [next characters, value of the
    piece that begins here or None]. One per Python worker; its size is the vocabulary's."""
    root: dict = {}
    for piece, score in unigram(path).items():
        level = root
        for c in reversed(piece):
            node = level.setdefault(c, [{}, None])
            level = node[0]
        node[1] = score * _ONE - 1
    return root


def count_words(words: list[str], root: dict) -> list[tuple[int, int]]:
    """(tokens, score) of each of the sorted distinct ``words``; every prefix is scored once."""
    out, path, best = [], "", [0]
    for word in words:
        shared, n = 0, min(len(path), len(word))
        while shared < n and path[shared] == word[shared]:
            shared += 1
        del best[shared + 1:]
        for i in range(shared, len(word)):
            c, top, level, j = word[i], None, root, i
            while True:
                node = level.get(word[j])
                if node is None:
                    break
                level, value = node
                if value is not None:
                    value += best[j]
                    if top is None or value > top:
                        top = value
                j -= 1
                if j < 0:
                    break
            own = root.get(c)
            if top is None or own is None or own[1] is None:
                size = len(c.encode())
                value = best[i] + size * BYTE_SCORE * _ONE - size
                top = value if top is None or value > top else top
            best.append(top)
        path = word
        pieces = -best[-1] % _ONE
        out.append((pieces, (best[-1] + pieces) // _ONE))
    return out


class Counter:
    """Terminal counts of a task's words: those of the present slice, and a bounded number of earlier ones."""

    def __init__(self, path: str):
        self.root, self.known = backward(path), Known(None)

    def words(self, words: list[bytes]) -> np.ndarray:
        """(tokens, score) of every word."""
        got = list(map(self.known.find, words))
        new = sorted((words[i].decode(), i) for i, x in enumerate(got) if x is None)
        for (_, i), value in zip(new, count_words(["\u2581" + w for w, _ in new], self.root)):
            got[i] = value
            self.known.put(words[i], value)
        return np.array(got, np.int64).reshape(-1, 2)

    def texts(self, column: pa.Array) -> list[np.ndarray]:
        """Words, tokens and score of every text; each distinct word of the column is looked up once."""
        w = Words(column)
        _, index, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        raw = w.data.tobytes()
        each = self.words([raw[x:y] for x, y in zip(w.start[index].tolist(), w.end[index].tolist())])[inverse]
        total = np.vstack([np.zeros((1, 2), np.int64), np.cumsum(each, axis=0)])[w.first]
        return [w.counts, *np.diff(total, axis=0).T]


def _count(path: str, slice_bytes: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.int64())])

    def run(batches):
        count = Counter(path)
        for batch in batches:
            ids, text = flat(batch.column("doc_id")), flat(batch.column("text"))
            for a, b in slices(text, slice_bytes):
                cols = count.texts(text.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a)] + [pa.array(c.astype(np.int64)) for c in cols], schema=schema)
    return run


def token_counts(docs: DataFrame, path: str | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_tokens, score for every row of ``docs`` (doc_id, text).

    Pre-tokens are runs of non-white-space, each with a word-begin mark. NULL and empty texts count 0.
    Rows are counted one by one, so repeated rows and NULL ids need no rule; an empty table gives no rows. Extra
    columns are ignored. No shuffle: every task shares work among the texts it reads.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(released(_count(path or vocabulary("piece_bpe_32k.model"), slice_bytes)), "doc_id long, n_words long, n_tokens long, score long")
