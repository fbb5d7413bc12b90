"""Operator 13 - aligning the tokens of two tokenizers by white-space anchors.

Both tokenizers take the whole text. An anchor is a byte offset at which a token of each ends and
after which a token of each begins with a space (the start and end of a text are anchors, too); ends
are verified on the tokens' bytes, which must join to the text exactly. Anchors divide a text into
windows, pairs of token-id tuples, and as a window's alignment depends on its ids alone, each
distinct window of a slice of texts is aligned once and remembered by its id tuples. An alignment
lists the groups (cut where both have an end) and the links (pairs of tokens that share bytes).

How many documents hold an id pair linked is counted over the whole corpus: a slice sends each
bucket its distinct pairs with their document counts, the bucket sums them and answers every slice
with its pairs' counts; the highest count per first id (one number per vocabulary entry, so bounded) goes to
all tasks. A frequent pair is one entry per slice, so no key is hot.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_folder, release, released, renewed, side
from .packed import Numbering, exchange_width, pack_numbers, ranges, row_batch, rows_table, unpack_numbers
from .packing import _byte_letters, vocabulary
from .text import flat, mix, offsets, prefix, run_hash, slices

SLICE_BYTES = 1_000_000
_LONG, _BIN = pa.int64(), pa.binary()
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


class Tokens:
    """A vocabulary's token bytes, and what encodes texts with it."""

    def __init__(self, table: list[bytes], encode):
        self.encode = encode                                              # texts -> (ids of all in a row, number of each)
        self.table = table
        self.size = np.fromiter(map(len, table), np.int64, len(table))
        self.at = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.spaced = np.fromiter((t[:1] == b" " for t in table), bool, len(table))
        self.names = [str(i).encode() for i in range(len(table))]
        self.marked = {m: [m + n for n in self.names] for m in (b";", b",", b"|")}

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.blob[ranges(self.at[ids], self.size[ids])]


@lru_cache(maxsize=2)
def byte_level(path: str) -> Tokens:
    """A byte-level vocabulary (JSON). Its merges are in the order of their ids (checked), so they are
    ranks; special tokens' strings in a text are plain text. A space is put before every text."""
    import public_tokenizers
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, special = spec["model"]["vocab"], {t["id"] for t in spec["added_tokens"]}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if merged != sorted(merged) or spec["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError(f"{path} is no byte-level vocabulary in rank order")
    byte = {letter: b for b, letter in _byte_letters().items()}
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        if i not in special:
            table[i] = bytes(byte[x] for x in token)
    ranks = {t: i for i, t in enumerate(table) if t}
    encoder = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokens(table, lambda texts: _rows([encoder.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]))


def _rows(arrays: list[np.ndarray]):
    return np.concatenate(arrays).astype(np.int64), np.fromiter(map(len, arrays), np.int64, len(arrays))


@lru_cache(maxsize=2)
def pieces(path: str) -> Tokens:
    """A piece vocabulary; it puts a space before every text itself. U+2581 stands for a space, <0xHH> for a byte."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    table = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) or m.is_unknown(i)
             else m.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]

    def encode(texts):
        lists = m.encode(texts, num_threads=1)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int64, n.sum()), n
    return Tokens(table, encode)


class Side:
    """One tokenizer's tokens of a slice: ids of all texts in a row, and each text's first token (one more than texts)."""

    def __init__(self, tokens: Tokens, texts: list[str]):
        self.tokens = tokens
        self.ids, n = tokens.encode(texts) if texts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.first = np.r_[0, np.cumsum(n)]

    def verified(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which texts their token bytes join to exactly; data: all texts' bytes, at: where each begins (one more)."""
        size = np.r_[0, np.cumsum(self.tokens.size[self.ids])][self.first]
        good = np.diff(size) == np.diff(at)
        for k in np.flatnonzero(good):
            good[k] = np.array_equal(self.tokens.joined(self.ids[self.first[k]:self.first[k + 1]]), data[at[k]:at[k + 1]])
        return good

    def only(self, keep: np.ndarray) -> None:
        n = np.diff(self.first)
        self.ids = self.ids[np.repeat(keep, n)]
        self.first = np.r_[0, np.cumsum(n[keep])]

    def ends(self) -> np.ndarray:
        return np.cumsum(self.tokens.size[self.ids])


def windows(a: Side, b: Side):
    """(first token in a, first token in b) of every window of the slice, one more than windows, and the
    first window of every text (one more than texts)."""
    ea, eb = a.ends(), b.ends()
    total = int(ea[-1]) if len(ea) else 0
    mark = np.zeros(total + 1, np.int8)
    mark[ea] += 1
    mark[eb] += 2
    shared = np.flatnonzero(mark == 3)
    ia, ib = np.searchsorted(ea, shared) + 1, np.searchsorted(eb, shared) + 1      # the tokens that begin there
    last = len(shared) - 1
    spaced = np.zeros(len(shared), bool)
    spaced[:last] = a.tokens.spaced[a.ids[ia[:last]]] & b.tokens.spaced[b.ids[ib[:last]]]
    text_end = np.zeros(len(a.ids) + 1, bool)
    text_end[a.first] = True
    anchor = np.flatnonzero(spaced | text_end[ia])
    wa, wb = np.r_[0, ia[anchor]], np.r_[0, ib[anchor]]
    return wa, wb, np.searchsorted(wa, a.first)


def distinct(a: Side, b: Side, wa: np.ndarray, wb: np.ndarray):
    """(one window of each kind, kind of every window): windows are of a kind where both id tuples are equal.
    A hash finds the kinds; the ids themselves are compared, and a window that differs is a kind of its own."""
    na, nb = np.diff(wa), np.diff(wb)
    ha = mix(run_hash(prefix(a.ids + 1), wa[:-1], wa[1:]) + na.astype(np.uint64), 1)
    hb = mix(run_hash(prefix(b.ids + 1), wb[:-1], wb[1:]) + nb.astype(np.uint64), 2)
    _, one, kind = np.unique(ha ^ (hb * np.uint64(3)), return_index=True, return_inverse=True)
    rep = one[kind]
    same = (na == na[rep]) & (nb == nb[rep])
    for side_, w, n in ((a, wa, na), (b, wb, nb)):
        i = np.flatnonzero(same)
        equal = side_.ids[ranges(w[i], n[i])] == side_.ids[ranges(w[rep[i]], n[i])]
        same[i[np.repeat(np.arange(len(i)), n[i])[~equal]]] = False
    other = np.flatnonzero(~same)
    kind[other] = len(one) + np.arange(len(other))
    return np.r_[one, other], kind


class Alignments:
    """The alignments of the distinct windows: groups and their text, and links."""

    def __init__(self, a: Side, b: Side, wa, wb, one: np.ndarray):
        na, nb = wa[one + 1] - wa[one], wb[one + 1] - wb[one]
        ia, ib = a.ids[ranges(wa[one], na)], b.ids[ranges(wb[one], nb)]
        ea, eb = np.cumsum(a.tokens.size[ia]), np.cumsum(b.tokens.size[ib])
        total = int(ea[-1]) if len(ea) else 0
        mark = np.zeros(total + 1, np.int8)
        mark[ea] += 1
        mark[eb] += 2
        # Between neighbouring ends (of either) lies one link: the token of a and that of b around those bytes.
        end = np.flatnonzero(mark)
        ka, kb = np.searchsorted(ea, end), np.searchsorted(eb, end)
        self.link_a, self.link_b = ia[ka], ib[kb]
        of_a, of_b = np.repeat(np.arange(len(one)), na), np.repeat(np.arange(len(one)), nb)
        self.n_links = np.bincount(of_a[ka], minlength=len(one))
        self.first_link = np.cumsum(self.n_links) - self.n_links
        cuts = np.flatnonzero(mark == 3)
        self.n_groups = np.bincount(of_a[np.searchsorted(ea, cuts)], minlength=len(one))
        self.text = self._texts(a.tokens, b.tokens, ia, ib, np.searchsorted(cuts, ea), np.searchsorted(cuts, eb), na + nb)

    @staticmethod
    def _texts(ta: Tokens, tb: Tokens, ia, ib, ga, gb, n) -> list[bytes]:
        """``;a1,a2|b1`` for every group of a window, in order."""
        order = np.argsort(np.r_[2 * ga, 2 * gb + 1], kind="stable")
        first_a, first_b = np.r_[True, ga[1:] != ga[:-1]][:len(ga)], np.r_[True, gb[1:] != gb[:-1]][:len(gb)]
        semi, comma, bar = ta.marked[b";"], ta.marked[b","], tb.marked[b"|"]
        comma_b = tb.marked[b","]
        words = [semi[i] if f else comma[i] for i, f in zip(ia.tolist(), first_a.tolist())] \
            + [bar[i] if f else comma_b[i] for i, f in zip(ib.tolist(), first_b.tolist())]
        words = [words[k] for k in order.tolist()]
        end = np.cumsum(n).tolist()
        return [b"".join(words[x:y]) for x, y in zip([0, *end[:-1]], end)]


def align(texts: list[str], first: Tokens, second: Tokens):
    """Alignment of a slice of texts (none empty): (which texts have tokens, numbers per such text (n_a, n_b, n_groups,
    n_links), digest of its groups, distinct pairs as a * size of b + b, (text, pair) entries as text * pairs + pair, how often each)."""
    column = pa.array([" " + t for t in texts], pa.large_string())
    data, at = offsets(column)
    a, b = Side(first, texts), Side(second, texts)
    good = a.verified(data, at) & b.verified(data, at)
    a.only(good)
    b.only(good)
    if not good.any():
        empty = np.zeros(0, np.int64)
        return good, np.zeros((4, 0), np.int64), [], empty, empty, empty
    wa, wb, of_text = windows(a, b)
    one, kind = distinct(a, b, wa, wb)
    found = Alignments(a, b, wa, wb, one)
    per = np.array([np.r_[0, np.cumsum(x[kind])][of_text] for x in (found.n_groups, found.n_links)])
    numbers = np.vstack([np.diff(a.first), np.diff(b.first), np.diff(per)])
    text = [found.text[k] for k in kind.tolist()]
    digest = [hashlib.sha256(b"".join(text[x:y])[1:]).hexdigest() for x, y in zip(of_text[:-1].tolist(), of_text[1:].tolist())]
    pairs, link = np.unique(found.link_a * len(second.table) + found.link_b, return_inverse=True)
    all_links = link[ranges(found.first_link[kind], found.n_links[kind])]
    entry, times = np.unique(np.repeat(np.arange(len(digest)), numbers[3]) * len(pairs) + all_links, return_counts=True)
    return good, numbers, digest, pairs, entry, times


_SLICE = pa.schema([("slice", _LONG), ("doc_ids", pa.list_(_LONG))] + [(n, pa.list_(_LONG)) for n in _NUMBERS]
                   + [("groups", pa.list_(pa.string())), ("pairs", _BIN), ("holders", _BIN), ("per_doc", _BIN), ("pair_of", _BIN), ("times", _BIN)])
SLICE = ("slice long, doc_ids array<long>, " + ", ".join(f"{n} array<long>" for n in _NUMBERS)
         + ", groups array<string>, pairs binary, holders binary, per_doc binary, pair_of binary, times binary")
_ASK = pa.schema([("bucket", pa.int32()), ("slice", _LONG), ("pairs", _BIN), ("holders", _BIN)])
ASK = "bucket int, slice long, pairs binary, holders binary"
_COUNTS = pa.schema([("bucket", pa.int32()), ("slice", _LONG), ("counts", _BIN), ("firsts", pa.list_(_LONG)), ("peaks", pa.list_(_LONG))])
COUNTS = "bucket int, slice long, counts binary, firsts array<long>, peaks array<long>"


def _deltas(pairs: np.ndarray) -> bytes:
    return pack_numbers(np.diff(pairs, prepend=0), 8)


def _pairs(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(packed, 8).astype(np.int64))


def _bucket(pairs: np.ndarray, n: int) -> np.ndarray:
    return (mix(pairs.astype(np.uint64), 3) % np.uint64(n)).astype(np.int64)


def _align(first: str, second: str, slice_bytes: int):
    def run(batches):
        a, b, number = byte_level(first), pieces(second), Numbering()
        for batch in batches:
            ids, text = batch.column("doc_id").to_pylist(), flat(batch.column("text"))
            for x, y in slices(text, slice_bytes):
                values = text.slice(x, y - x).to_pylist()
                full = np.array([bool(t) for t in values])
                good, numbers, digest, pairs, entry, times = align([t for t in values if t], a, b)
                full[full] = good                                          # the texts that have tokens
                every = np.zeros((4, len(values)), np.int64)
                every[:, full] = numbers
                groups = np.full(len(values), "", object)
                groups[full] = digest
                n = max(len(pairs), 1)
                per_doc = np.zeros(len(values), np.int64)
                per_doc[full] = np.bincount(entry // n, minlength=int(full.sum()))
                yield row_batch((number(), ids[x:y], *every.tolist(), groups.tolist(), _deltas(pairs), pack_numbers(np.bincount(entry % n, minlength=len(pairs))),
                                 pack_numbers(per_doc), pack_numbers(entry % n), pack_numbers(times)), _SLICE)
    return run


def _ask(n: int):
    """Every slice sends each bucket its distinct pairs and how many of its documents hold them."""
    def run(batches):
        for batch in batches:
            for number, packed, held in zip(*(batch.column(c).to_pylist() for c in ("slice", "pairs", "holders"))):
                pairs, held = _pairs(packed), unpack_numbers(held)
                if not len(pairs):
                    continue
                to = _bucket(pairs, n)
                order = np.argsort(to, kind="stable")                      # pairs stay in rising order
                at = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0])
                rows = [(int(to[i[0]]), number, _deltas(pairs[i]), pack_numbers(held[i])) for i in np.split(order, at[1:])]
                yield from rows_table(rows, _ASK).to_batches()
    return run


def _count(size_b: int):
    """Within a bucket: documents per pair; answers to the slices, and one row with the highest count of each first id."""
    def run(t: pa.Table) -> pa.Table:
        parts, held = [_pairs(p) for p in t["pairs"].to_pylist()], [unpack_numbers(p) for p in t["holders"].to_pylist()]
        pairs, place = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, place, np.concatenate(held).astype(np.int64))
        bucket, end = t["bucket"][0].as_py(), np.cumsum([len(p) for p in parts])
        rows = [(bucket, s, pack_numbers(total[p], 8), None, None) for s, p in zip(t["slice"].to_pylist(), np.split(place, end[:-1]))]
        first = pairs // size_b
        at = np.flatnonzero(np.r_[True, np.diff(first) != 0])
        rows.append((bucket, None, None, first[at].tolist(), np.maximum.reduceat(total, at).tolist()))
        return rows_table(rows, _COUNTS)
    return run


_OUT = pa.schema([("doc_id", _LONG)] + [(n, _LONG) for n in (*_NUMBERS, "n_best", "count_sum")] + [("groups_sha256", pa.string())])
OUT = "doc_id long, " + ", ".join(f"{n} long" for n in (*_NUMBERS, "n_best", "count_sum")) + ", groups_sha256 string"


def _finish(n: int, size_b: int, peaks):
    """Within a slice: counts joined back to its pairs and summed over each document's links."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = side(left, _SLICE), side(right, _COUNTS)
        rows = []
        answers = {b: unpack_numbers(c, 8) for b, c in zip(right["bucket"].to_pylist(), right["counts"].to_pylist())}
        for r in left.to_pylist():
            pairs = _pairs(r["pairs"])
            to, count = _bucket(pairs, n), np.zeros(len(pairs), np.int64)
            order = np.argsort(to, kind="stable")
            if len(pairs):
                at = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0])
                count[order] = np.concatenate([answers[int(to[order[i]])].astype(np.int64) for i in at])
            best = count == peaks.value[pairs // size_b]
            pair, times = unpack_numbers(r["pair_of"]).astype(np.int64), unpack_numbers(r["times"]).astype(np.int64)
            end = np.r_[0, np.cumsum(unpack_numbers(r["per_doc"]).astype(np.int64))]
            n_best, total = (np.diff(np.r_[0, np.cumsum(times * x[pair])][end]) for x in (best.astype(np.int64), count))
            rows += zip(r["doc_ids"], *(r[c] for c in _NUMBERS), n_best.tolist(), total.tolist(), r["groups"])
        return rows_table(rows, _OUT)
    return run


def align_tokens(docs: DataFrame, first: str | None = None, second: str | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs`` (doc_id, text).

    first: a byte-level vocabulary, second: a piece vocabulary. Texts that are NULL, empty or not given
    back exactly by the bytes of either token row have no tokens: zeros and an empty digest. Every row counts as
    a document, repeated rows and rows without an id too; extra columns are ignored; an empty table gives no rows.
    Memory of a task follows the slice (or one longer text).
    """
    spark = docs.sparkSession
    first, second = first or vocabulary("byte_bpe_50k.json"), second or vocabulary("piece_bpe_32k.model")
    size_a, size_b = len(byte_level(first).table), len(pieces(second).table)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = exchange_width(d)
    folder = fresh_folder(spark, "alignment")
    d.mapInArrow(released(_align(first, second, slice_bytes)), SLICE).write.parquet(f"{folder}/slices")
    cuts = spark.read.schema(SLICE).parquet(f"{folder}/slices")
    asked = cuts.select("slice", "pairs", "holders").mapInArrow(released(_ask(n)), ASK)
    asked.repartition(n, "bucket").groupBy("bucket").applyInArrow(_count(size_b), COUNTS).write.parquet(f"{folder}/counts")
    counts = spark.read.schema(COUNTS).parquet(f"{folder}/counts")
    top = (counts.filter("slice IS NULL").select(F.explode(F.arrays_zip("firsts", "peaks")).alias("x"))
           .groupBy(F.col("x.firsts").alias("id")).agg(F.max("x.peaks").alias("peak")).collect())     # one row per vocabulary entry at most
    peak = np.zeros(size_a, np.int64)
    for r in top:
        peak[r["id"]] = r["peak"]
    answers = counts.filter("slice IS NOT NULL")
    return (cuts.repartition(n, "slice").groupBy("slice").cogroup(renewed(answers).groupBy("slice"))
            .applyInArrow(_finish(n, size_b, spark.sparkContext.broadcast(peak)), OUT))
