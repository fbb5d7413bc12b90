"""Operator 12 - byte-level BPE encoding and decoding over a global table of distinct words.

Encoding: tasks cut their texts into pre-tokens and explode them with positions, a slice of a few
megabytes at a time: the slice keeps a row with the position list (numbers of its distinct words in
text order) and sends each of its distinct words, once, to the word's bucket. A bucket merges the
words of all slices, encodes every distinct word once by byte-pair merging and answers each slice
with the ids of its own words. The slice joins the ids back and reassembles its documents by
position. A frequent word is one entry per slice, so no key is hot. Slices and answers meet in one
exchange, which the word branch reads as well.

Decoding joins every id with the token-byte table (as many rows as the vocabulary, so of bounded
size) and puts the bytes together in order.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, released, renewed, side
from .packed import (Numbering, exchange_width, pack_ids, pack_numbers, pack_strings, ranges, row_batch, rows_table,
                     unpack_ids, unpack_numbers, unpack_strings)
from .packing import vocabulary
from .text import flat, slices

SLICE_BYTES = 4_000_000
_LONG, _BIN = pa.int64(), pa.binary()
_SLICE = pa.schema([("slice", _LONG), ("doc_ids", pa.list_(_LONG)), ("sizes", _BIN), ("positions", _BIN), ("words", _BIN)])
SLICE = "slice long, doc_ids array<long>, sizes binary, positions binary, words binary"
_ASK = pa.schema([("bucket", pa.int32()), ("slice", _LONG), ("packed", _BIN)])
ASK = "bucket int, slice long, packed binary"
_IDS = pa.schema([("doc_id", _LONG), ("ids", _BIN)])


def word_pattern() -> str:
    """The public pattern that cuts texts into pre-tokens."""
    import public_tokenizers
    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


def bucket_of(word: bytes, n: int) -> int:
    return zlib.crc32(word) % n


def _split(pattern: str, slice_bytes: int):
    """Texts -> slices of positions and distinct words."""
    def run(batches):
        import regex
        words_of, number = regex.compile(pattern).findall, Numbering()
        for batch in batches:
            ids, text = batch.column("doc_id").to_pylist(), flat(batch.column("text"))
            for a, b in slices(text, slice_bytes):
                known = defaultdict(count().__next__)
                place, sizes = [], []
                for t in text.slice(a, b - a).to_pylist():
                    words = words_of(t) if t else []
                    sizes.append(len(words))
                    place.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                yield row_batch((number(), ids[a:b], pack_numbers(np.array(sizes)), pack_numbers(np.concatenate(place)),
                                 pack_strings([w.encode() for w in known])), _SLICE)
    return run


def _ask(n: int):
    """Every slice sends each bucket its distinct words there."""
    def run(batches):
        for batch in batches:
            for number, packed in zip(batch.column("slice").to_pylist(), batch.column("words")):
                words = defaultdict(list)
                for w in unpack_strings(packed.as_py()):
                    words[bucket_of(w, n)].append(w)
                yield pa.RecordBatch.from_pylist([{"bucket": k, "slice": number, "packed": pack_strings(v)} for k, v in words.items()], _ASK)
    return run


def _encode(path: str, pattern: str):
    """Within a bucket: each distinct word is encoded once; every slice gets the ids of its words."""
    def run(t: pa.Table) -> pa.Table:
        encoder, known, rows = _encoder(path, pattern), {}, []
        for number, packed in zip(t["slice"].to_pylist(), t["packed"]):
            ids = []
            for w in unpack_strings(packed.as_py()):
                if w not in known:
                    known[w] = np.array(encoder.encode_ordinary(w.decode()), "<u4").tobytes()
                ids.append(known[w])
            rows.append((t["bucket"][0].as_py(), number, pack_ids(ids)))
        del known
        release()
        return rows_table(rows, _ASK)
    return run


def _assemble(n: int, then=None):
    """Within a slice: ids joined back to its words, documents put together by position, and handed on to ``then``."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = side(left, _SLICE), side(right, _ASK)
        if not len(left):
            return _IDS.empty_table()
        words = unpack_strings(left["words"][0].as_py())
        bucket = np.fromiter((bucket_of(w, n) for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")                         # buckets answer in the order they were asked in
        answers = [unpack_ids(p) for _, p in sorted(zip(right["bucket"].to_pylist(), right["packed"].to_pylist()))]
        size, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size[order] = np.concatenate([a[0] for a in answers]) if answers else 0
        at[order] = np.cumsum(size[order]) - size[order]
        found = np.concatenate([a[1] for a in answers]) if answers else np.zeros(0, "<u4")
        place = unpack_numbers(left["positions"][0].as_py())
        per = size[place]
        ids = found[ranges(at[place], per)]
        end = np.r_[0, np.cumsum(per)][np.r_[0, np.cumsum(unpack_numbers(left["sizes"][0].as_py()).astype(np.int64))]]
        out = rows_table([(d, ids[a:b].tobytes()) for d, a, b in zip(left["doc_ids"][0].as_py(), end[:-1], end[1:])], _IDS)
        if then is not None:
            out = pa.Table.from_batches(then(out.to_batches()))
        release()
        return out
    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, slice_bytes: int = SLICE_BYTES,
           then=None, schema: str = "doc_id long, ids binary") -> DataFrame:
    """doc_id, ids (token ids, little-endian unsigned 32-bit) for every row of ``docs`` (doc_id, text).

    path: ranks of a byte-level vocabulary; pattern: what cuts a text into pre-tokens. NULL and empty
    texts have no ids. Rows are encoded one by one, so repeated rows and NULL ids stay as they are; extra
    columns are ignored; an empty table gives no rows. A very long text is a slice of its own. ``then`` (batches ->
    batches of ``schema``) takes up the rows in the task that made them.
    """
    path, pattern = path or vocabulary("byte_bpe_multi_50k.tiktoken"), pattern or word_pattern()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = exchange_width(d)
    cuts = d.mapInArrow(released(_split(pattern, slice_bytes)), SLICE).repartition(n, "slice")
    answers = cuts.mapInArrow(released(_ask(n)), ASK).repartition(n, "bucket").groupBy("bucket").applyInArrow(_encode(path, pattern), ASK)
    return cuts.groupBy("slice").cogroup(renewed(answers).groupBy("slice")).applyInArrow(_assemble(n, then), schema)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: the bytes of every id."""
    ranks = _ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _decode(path: str, keep: list[str]):
    def run(batches):
        table = token_bytes(path)
        for batch in batches:
            out = [None if v is None else b"".join(map(table.__getitem__, np.frombuffer(v, "<u4").tolist())) for v in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, _BIN)], names=[*keep, "bytes"])
    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of ``encoded`` (doc_id, ids, others but ``bytes``) and ``bytes``, the text's UTF-8 form.
    NULL ids give NULL; an id outside the vocabulary is an error. No shuffle."""
    path = path or vocabulary("byte_bpe_multi_50k.tiktoken")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", bytes binary"
    return encoded.mapInArrow(released(_decode(path, encoded.columns)), schema)


def _digests(batches):
    import hashlib
    names = [str(i).encode() for i in range(1 << 16)]
    schema = pa.schema([("doc_id", _LONG), ("n_tokens", _LONG), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def text(i: int) -> bytes:
        return names[i] if i < len(names) else str(i).encode()
    for batch in batches:
        rows = []
        for doc, ids, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "bytes"))):
            ids = np.frombuffer(ids, "<u4").tolist()
            rows.append((doc, len(ids), hashlib.sha256(b",".join(map(text, ids))).hexdigest(), hashlib.sha256(raw).hexdigest()))
        yield from rows_table(rows, schema).to_batches()


def round_trip(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of what they decode to, decoded
    in the task that put the ids together."""
    back = _decode(path or vocabulary("byte_bpe_multi_50k.tiktoken"), ["doc_id", "ids"])
    return encode(docs, path, then=lambda batches: _digests(back(batches)),
                  schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", **how)
