"""Operator 8 - packing documents into sequences by large-item matching and best fit.

Documents are tokenised in tasks; only those longer than a sequence are cut. The packing itself works
on the histogram of piece lengths, which has at most ``capacity`` entries whatever the size of the
corpus: pieces above a third of the capacity are paired (at most two to a sequence) by greedy
matching, longest first with the longest partner that still fits; shorter pieces go, longest first, to
the sequence with the smallest gap that takes them. Equal lengths and equal gaps are handled in one
step, so the plan is a bounded list of runs: "ranks a..b of length l go to sequences s, s+1, ... at
offset o". Every piece then finds its place from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import bisect
import re
import struct
import unicodedata
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parallelism, release
from .text import Words, flat, slices

CACHE_BYTES = 64 << 20                    # bound of a task's cache of words already tokenised
_FOUR = [struct.Struct(f"<{n}I").pack for n in range(16)]      # ids as little-endian 32-bit bytes
_ENTRY = 170                              # bytes of an entry besides its key's and value's own


class Known(dict):
    """A cache of byte strings bounded in bytes, in two generations: unknown keys are worked out by ``learn``; when
    the young generation has half of the bound it becomes the old one, and what is asked for again moves back, so
    frequent keys stay. It belongs to a task and ends with it."""

    def __init__(self, learn, bound: int = CACHE_BYTES):
        super().__init__()
        self.learn, self.bound, self.size, self.old = learn, bound, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        value = self.learn(key) if value is None else value
        self.put(key, value)
        return value

    def many(self, keys: list[bytes]) -> list:
        """The values of many keys; the bound is looked at once."""
        got = list(map(self.get, keys))
        new, old, learn = {}, self.old.get, self.learn
        for i, value in enumerate(got):
            if value is None:
                key = keys[i]
                value = old(key)
                new[key] = got[i] = learn(key) if value is None else value
        self.update(new)
        self.size += _ENTRY * len(new) + sum(map(len, new)) + sum(map(len, new.values()))
        if 2 * self.size > self.bound:
            self.old, self.size = dict(self), 0
            self.clear()
        return got

    def find(self, key):
        """What is known of the key, or None."""
        value = self.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: bytes, value) -> None:
        if 2 * self.size > self.bound:
            self.old, self.size = dict(self), 0
            self.clear()
        self[key] = value
        self.size += _ENTRY + len(key) + len(value)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file installed on every node."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself where it is
    printable Latin-1, else the next free character from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in own]
    return {x: chr(x) for x in own} | {x: chr(256 + k) for k, x in enumerate(rest)}


class WordTokens:
    """Token ids of texts, as little-endian 32-bit bytes. The tokenizer drops white space and never
    merges across it, so a text's ids are its words' ids in a row, and words are cached (for one task).

    Words made of letters with other marks than an apostrophe behind are two pre-tokens, which go to
    the vocabulary's merge model directly; all other words take the tokenizer's whole path.
    """

    def __init__(self, path: str):
        self.words = Known(self._ids)
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.plain = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")
        self.marks = Known(self._part, 1 << 20)

    def _part(self, pre_token: str) -> bytes:
        raw = pre_token if pre_token.isascii() else pre_token.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(raw)] if raw else []
        return _FOUR[len(ids)](*ids) if len(ids) < len(_FOUR) else struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, word: bytes) -> bytes:
        s = word.decode()
        m = self.plain.fullmatch(s)
        if m:
            letters, marks = m.groups()
            if s.isascii() or (letters + letters.lower()).isalpha() and "Σ" not in s and unicodedata.is_normalized("NFC", s):
                return self._part(letters.lower()) + self.marks[marks] if marks else self._part(letters.lower())
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def texts(self, column: pa.Array) -> list[bytes]:
        """The ids of every text. Each distinct word of the column is looked up once (words are told
        apart by their 64-bit hash) and its ids are copied to where it occurs."""
        w = Words(column)
        values, inverse = distinct_words(w, self.words)
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids = np.frombuffer(b"".join(values), "<u4")
        at, n = (np.cumsum(size) - size)[inverse], size[inverse]
        end = np.cumsum(n)
        ids = ids[np.repeat(at - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        bound = np.r_[0, end][w.first]
        return [ids[x:y].tobytes() for x, y in zip(bound[:-1], bound[1:])]


def distinct_words(w: Words, known: Known) -> tuple[list, np.ndarray]:
    """(what is known of every distinct word, which of them each word is)."""
    _, index, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    raw = w.data.tobytes()
    return known.many([raw[x:y] for x, y in zip(w.start[index].tolist(), w.end[index].tolist())]), inverse


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """One per Python worker; its size is the vocabulary's."""
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def _pieces(path: str, end_id: int, capacity: int, keep_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
                       + ([("ids", pa.binary())] if keep_ids else []))

    def run(batches):
        tokens = WordTokens(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, text = batch.column("doc_id").to_pylist(), flat(batch.column("text"))
            for a, b in slices(text):
                rows = []
                for doc, t in zip(ids[a:b], tokens.texts(text.slice(a, b - a))):
                    t += end
                    for p, at in enumerate(range(0, len(t), 4 * capacity)):
                        x = t[at:at + 4 * capacity]
                        rows.append((doc, p, at // 4, len(x) // 4, zlib.crc32(x)) + ((x,) if keep_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        del tokens
        release()
    return run


def pieces(docs: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of every piece; NULL text is empty."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_pieces(path or vocabulary(), end_id, capacity, keep_ids), schema)


class Plan:
    """Packs a histogram {length: count}. runs: (length, first rank, end rank, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.next = capacity, dict(counts), 0
        self.rank = defaultdict(int)
        self.runs: list[tuple] = []
        self.gaps: dict[int, list] = defaultdict(list)       # gap -> [(first sequence, number)]
        self.sizes: list[int] = []                           # the gaps in use, ascending
        self._large([x for x in counts if 3 * x > capacity])
        for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
            self._small(length)

    def _place(self, length: int, n: int, sequence: int, offset: int) -> None:
        r = self.rank[length]
        self.runs.append((length, r, r + n, sequence, offset))
        self.rank[length] = r + n
        self.left[length] -= n

    def _open(self, gap: int, sequence: int, n: int) -> None:
        if n and gap:
            if gap not in self.gaps:
                bisect.insort(self.sizes, gap)
            self.gaps[gap].append((sequence, n))

    def _take(self, gap: int):
        run = self.gaps[gap].pop()
        if not self.gaps[gap]:
            del self.gaps[gap]
            del self.sizes[bisect.bisect_left(self.sizes, gap)]
        return run

    def _large(self, lengths: list[int]) -> None:
        waiting = sorted(lengths)
        while waiting:
            x = waiting[-1]
            # The longest partner that still fits; several of x may pair among themselves.
            i = bisect.bisect_right(waiting, self.capacity - x) - 1
            if i < 0:
                n = self.left[x]
                self._place(x, n, self.next, 0)
                self._open(self.capacity - x, self.next, n)
                self.next += n
            else:
                y = waiting[i]
                n = self.left[x] // 2 if y == x else min(self.left[x], self.left[y])
                if n:
                    self._place(x, n, self.next, 0)
                    self._place(y, n, self.next, x)
                    self._open(self.capacity - x - y, self.next, n)
                    self.next += n
                if y == x and self.left[x]:                  # an odd one: the next shorter partner, or alone
                    if len(waiting) > 1:
                        y = waiting[-2]
                        self._place(x, 1, self.next, 0)
                        self._place(y, 1, self.next, x)
                        self._open(self.capacity - x - y, self.next, 1)
                    else:
                        self._place(x, 1, self.next, 0)
                        self._open(self.capacity - x, self.next, 1)
                    self.next += 1
            waiting = [z for z in waiting if self.left[z]] if not self.left[x] or i >= 0 and not self.left[waiting[i]] else waiting

    def _small(self, length: int) -> None:
        while self.left[length]:
            n = self.left[length]
            i = bisect.bisect_left(self.sizes, length)
            if i == len(self.sizes):
                gap, (sequence, bins) = self.capacity, (self.next, -(-n // (self.capacity // length)))
                self.next += bins
            else:
                gap = self.sizes[i]
                sequence, bins = self._take(gap)
            fit = gap // length                              # best fit fills a sequence before it turns to the next
            full = min(bins, n // fit)
            for k in range(fit if full else 0):
                self._place(length, full, sequence, self.capacity - gap + k * length)
            self._open(gap - fit * length, sequence, full)
            rest = min(n - full * fit, fit) if full < bins else 0
            for k in range(rest):
                self._place(length, 1, sequence + full, self.capacity - gap + k * length)
            if rest:
                self._open(gap - rest * length, sequence + full, 1)
            self._open(gap, sequence + full + bool(rest), bins - full - bool(rest))


def pack(p: DataFrame, capacity: int = 4096) -> DataFrame:
    """p plus sequence_id and offset. The rank of a piece among those of its length is taken in salted
    parts (salt by hash of doc_id and piece), so that a length held by a third of all pieces is spread
    over many tasks; only counts per (length, salt) and the plan's runs are joined back."""
    salts = 4 * parallelism(p.sparkSession)
    p = p.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = cut(p.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("_n")).collect()}   # at most ``capacity`` rows
    runs = Plan(histogram, capacity).runs
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (p.withColumn("_r", F.row_number().over(order) - 1)
              .join(base, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s")))
              .withColumn("_rank", F.col("_base") + F.col("_r")))
    # The plan is bounded by the capacity (about two runs per length and gap), not by the corpus.
    plan = p.sparkSession.createDataFrame(runs or [(0, 0, 0, 0, 0)], "_pl long, _from long, _to long, _sequence long, offset long")
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_pl")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    names = [c for c in p.columns if c != "_salt"]
    return placed.select(*names, (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, capacity: int = 4096, **how) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    NULL and empty texts are one piece holding the end id alone. Rows that repeat a doc_id, or equal
    rows, are pieces of their own. Extra columns are ignored; an empty table gives no rows.
    """
    return pack(cut(pieces(docs, capacity, **how)), capacity)
