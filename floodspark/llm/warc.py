"""Operator 9 - web archives (WARC): writing, and reading with boundary-chain verification.

Writing: one record per page through Spark's text sink, whose line separator is the blank line that
ends a WARC record. Of pages with equal payloads the one with the smallest page_id becomes a
``response``, the others ``revisit`` records that refer to it.

Reading: the archives are read by Spark's splittable text source with the magic line as separator,
so every task sees the candidate records of its byte range. A payload may contain the magic line,
so a candidate is only believed if it lies on the chain of record lengths that begins at the file's
start: each task emits for its candidates the offset of the successor (and where the chain leaves
the task's range), the chains of the ranges are connected by pointer jumping from offset 0, and
only reachable candidates are records. A record whose payload holds the magic line is put together
from its segments afterwards.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh_folder
from .packed import rows_table

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id) -> str:
    h = hashlib.md5(f"page:{page_id}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _clean(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def _compressed(shared, hits: bool):
    """Rows whose payload may occur again (``hits``), compressed to travel to where their duplicates are
    decided; or the other rows, as records."""
    def run(batches):
        import zstandard
        z = zstandard.ZstdCompressor(level=12)
        bits = shared.value
        for b in batches:
            at = b.column("places").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            seen = ((bits[at >> 6] >> (at & 63)) & 1).all(axis=1)
            b = b.filter(pa.array(seen == hits)).drop_columns(["places"])
            i = b.schema.get_field_index("payload")
            packed = pa.array([z.compress(x.encode()) for x in b.column(i).to_pylist()] if hits else b.column(i).cast(pa.binary()), pa.binary())
            yield pa.RecordBatch.from_arrays([packed if k == i else b.column(k) for k in range(b.num_columns)], names=b.schema.names)
    return run


def repeated_filter(keys: DataFrame, places, words: int = 1 << 17) -> np.ndarray:
    """A Bloom filter of the keys that occur more than once: ``words`` numbers of 64 bits, whatever the
    table's size (a fuller filter lets more single payloads travel, none is lost)."""
    bits = (keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.explode(places).alias("at"))
            .groupBy(F.expr("at >> 6").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits")))
    out = np.zeros(words, np.int64)
    for r in bits.collect():                                 # at most ``words`` rows
        out[r["word"]] = r["bits"]
    return out


def _records(batches):
    import zstandard
    z = zstandard.ZstdDecompressor()
    for b in batches:
        out = []
        together = "first_id" in b.schema.names                # rows that came through the shuffle, compressed
        firsts = b.column("first_id").to_pylist() if together else [None] * len(b)
        for page, url, payload, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload")), firsts):
            payload = z.decompress(payload) if together else payload
            html = payload.decode()
            revisit = page is not None and first is not None and first != page
            http = b"" if revisit else (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                                        b"Content-Length: %d\r\n\r\n" % len(payload))
            head = [f"WARC-Type: {'revisit' if revisit else 'response'}",
                    f"WARC-Record-ID: {_record_id(page)}", f"WARC-Date: {_DATE}"]
            head += [f"WARC-Target-URI: {_clean(url)}"] if url else []
            head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"X-Payload-Bytes: {len(payload)}"]
            head += [f"X-Page-Id: {page}"] if page is not None else []
            if revisit:
                head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
                         f"WARC-Refers-To: {_record_id(first)}", f"X-Refers-To-Page: {first}"]
            else:
                head += ["Content-Type: application/http; msgtype=response"]
            head += [f"Content-Length: {0 if revisit else len(http) + len(payload)}"]
            out.append(MAGIC + "\r\n".join(head) + END + http.decode() + ("" if revisit else html))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> str:
    """Write one record per row of ``pages`` (page_id, url, html) and return the folder.

    NULL html is an empty payload. Payloads of at least ``min_revisit_bytes`` bytes that occur again
    become revisits of the smallest page_id with that payload; rows without a page_id are always
    responses and never referred to; rows repeating the winning page_id are responses too. Extra
    columns are ignored; an empty table writes an empty folder.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("key"))
    large, words = p.filter(F.octet_length("payload") >= min_revisit_bytes).select("page_id", "key"), 1 << 17
    places = F.array(*[F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(64 * words)) for seed in range(4)])
    shared = spark.sparkContext.broadcast(repeated_filter(large, places, words))
    first = large.groupBy("key").agg(F.min("page_id").alias("first_id"))
    p = p.withColumn("places", places)
    row = "page_id long, url string, payload binary, key binary"
    again = p.mapInArrow(_compressed(shared, True), row)
    again = again.join(first, "key", "left").select("page_id", "url", "payload", "first_id").mapInArrow(_records, "value string")
    single = _compressed(shared, False)
    once = p.mapInArrow(lambda batches: _records(single(batches)), "value string")
    once.union(again).write.option("lineSep", END).text(folder)
    return folder


_CANDIDATE = ("file string, block long, seq int, at long, bytes long, next long, exit long, done boolean, "
              "type string, page_id long, refers_to long, said_digest string, said_bytes long, digest string, payload_bytes long")


def _parse(seg: bytes):
    """(header fields, header bytes, declared length) of a candidate, or None."""
    cutoff = seg.find(b"\r\n\r\n")
    if cutoff < 0:
        return None
    fields = {}
    for line in seg[:cutoff].split(b"\r\n"):
        name, sep, value = line.partition(b":")
        if not sep:
            return None
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    size = fields.get(b"content-length", "")
    if not size.isdigit() or b"warc-type" not in fields:
        return None
    return fields, cutoff + 4, int(size)


def _payload(block: bytes) -> bytes:
    """The body of an HTTP response block."""
    return block.partition(b"\r\n\r\n")[2]


def _number(text):
    return int(text) if text and text.lstrip("-").isdigit() else None


def _candidates(batches):
    """Per byte range: a row for every segment; offsets count from the range's first segment."""
    rows, now, at, seq = [], None, 0, 0
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[t])
                        for n, t in (c.split() for c in _CANDIDATE.split(", "))])

    def flush():
        where = {r["at"]: r for r in rows}
        for r in reversed(rows):                       # follow the chain to where it leaves the range
            n = where.get(r["next"])
            r["exit"] = r["next"] if n is None or n["exit"] is None else n["exit"]
        return pa.RecordBatch.from_pylist(rows, schema)

    for b in batches:
        for file, block, value in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value"))):
            if (file, block) != now:
                if rows:
                    yield flush()
                rows, now, at, seq = [], (file, block), 0, 0
            seg = value.encode()
            r = dict.fromkeys(schema.names) | {"file": file, "block": block, "seq": seq, "at": at, "bytes": len(seg), "done": False}
            if (p := _parse(seg)) is not None:
                fields, head, size = p
                r["next"] = at + len(MAGIC) + head + size + len(END)
                r["done"] = len(seg) == head + size + len(END)
                r["type"] = fields[b"warc-type"]
                r["page_id"], r["refers_to"] = _number(fields.get(b"x-page-id")), _number(fields.get(b"x-refers-to-page"))
                r["said_digest"] = fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
                r["said_bytes"] = _number(fields.get(b"x-payload-bytes"))
                if r["done"] and r["type"] == "response":
                    payload = _payload(seg[head:head + size])
                    r["digest"], r["payload_bytes"] = digest32(payload), len(payload)
            rows.append(r)
            at += len(seg) + len(MAGIC)
            seq += 1
    if rows:
        yield flush()


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _mark(t: pa.Table) -> pa.Table:
    """Within one range: follow the chain from the entry; keep its records."""
    rows = sorted(t.to_pylist(), key=lambda r: r["at"])
    where = {r["at"]: r for r in rows}
    r = next((x for x in rows if x["entry"]), None)
    kept = set()
    while r is not None:
        kept.add(r["at"])
        r = where.get(r["next"])
    for x in rows:
        x["real"] = x["at"] in kept
    return pa.Table.from_pylist(rows, t.schema.append(pa.field("real", pa.bool_())))


def _joined(batches):
    """Digest of records that were put together from several segments."""
    for b in batches:
        out = []
        for file, at, parts in zip(b.column("file").to_pylist(), b.column("own").to_pylist(), b.column("parts").to_pylist()):
            seg = MAGIC.encode().join(p["value"].encode() for p in parts)
            head, size = _parse(seg)[1:]
            payload = _payload(seg[head:head + size])
            out.append({"file": file, "own": at, "full_digest": digest32(payload), "full_bytes": len(payload)})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("own", pa.int64()),
                                                         ("full_digest", pa.string()), ("full_bytes", pa.int64())]))


def _base(t: DataFrame) -> DataFrame:
    """Offset of every range's first segment: bytes of the ranges before it in the file."""
    per = t.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("size"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # The segment before the first magic (empty in a sound file) shifts all offsets by the magic's length.
    return per.select("file", "block", (F.coalesce(F.sum("size").over(w), F.lit(0)) - len(MAGIC)).alias("base"))


def reachable(cands: DataFrame) -> DataFrame:
    """Pointer jumping: from offset 0 of every file over the ranges' exits; (file, at) of the entries.

    After round i the table ``jump`` leaps over 2^i ranges and ``seen`` holds the first 2^i entries of
    each chain; the number of rounds is the logarithm of the ranges of the longest file."""
    jump = cands.filter("exit IS NOT NULL").select("file", "at", F.col("exit").alias("to"))
    seen = cands.filter("at = 0").select("file", "at")
    ranges = cands.groupBy("file").agg(F.count_distinct("block").alias("n")).agg(F.max("n")).first()[0] or 1
    span = 1
    while span < ranges:
        seen = cut(seen.union(seen.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct())
        jump = cut(jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("to2")), ["file", "to"])
                   .select("file", "at", F.col("to2").alias("to")))
        span *= 2
    return seen


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """file, offset, type, page_id, refers_to, payload_bytes, payload_digest, digest_ok of every record.

    Digests and sizes of responses are computed from the archive's bytes and compared with the header
    (``digest_ok``); revisits have no payload: they carry what their header says, and ``digest_ok`` is NULL.
    Candidates that are not on the chain from the file's start are left out.
    """
    found = cut(_segments(spark, folder).mapInArrow(_candidates, _CANDIDATE))
    c = found.join(_base(found), ["file", "block"])
    c = c.withColumns({x: F.col(x) + F.col("base") for x in ("at", "next", "exit")})
    c = cut(c.drop("base"))
    entry = reachable(c.filter("next IS NOT NULL")).withColumn("entry", F.lit(True))
    e = c.join(entry, ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    columns = ", ".join(f"{n} {t}" for n, t in e.dtypes)
    e = cut(e.groupBy("file", "block").applyInArrow(_mark, columns.replace("bigint", "long") + ", real boolean"))
    # Segments that are no records of their own belong to the record before them.
    owner = F.last(F.when(F.col("real"), F.struct("at", "done")), ignorenulls=True).over(
        Window.partitionBy("file").orderBy("at"))
    inner = cut(e.filter("at >= 0").select("file", "block", "seq", "at", owner.alias("o"))
             .filter("o.at IS NOT NULL AND NOT o.done").select("file", "block", "seq", "at", F.col("o.at").alias("own")))
    if inner.isEmpty():                                      # nothing to put together
        whole = spark.createDataFrame([], "file string, at long, full_digest string, full_bytes long")
    else:
        whole = _whole(spark, folder, inner)
    r = e.filter("real").join(whole, ["file", "at"], "left")
    response = F.col("type") == "response"
    digest, size = F.coalesce("digest", "full_digest"), F.coalesce("payload_bytes", "full_bytes")
    sound = digest.eqNullSafe(F.col("said_digest")) & size.eqNullSafe(F.col("said_bytes"))
    return r.select("file", F.col("at").alias("offset"), "type", "page_id", "refers_to", F.when(response, size).otherwise(F.col("said_bytes")).alias("payload_bytes"),
                    F.when(response, digest).otherwise(F.col("said_digest")).alias("payload_digest"), F.when(response, sound).alias("digest_ok"))


def _whole(spark: SparkSession, folder: str, inner: DataFrame) -> DataFrame:
    """file, at, digest and size of the records in several segments. The files concerned are read again; as
    Spark may split them otherwise than before, segments are found by their offset in the file, which
    is counted from that second reading (written to a table, so that it is one reading)."""
    files = inner.select("file").distinct()
    again = fresh_folder(spark, "warc-segments")
    (_segments(spark, folder).join(files, "file", "left_semi").mapInArrow(_placed, "file string, block long, at long, bytes long, value string")
     .write.option("compression", "zstd").parquet(again))
    text = spark.read.parquet(again)
    text = text.join(_base(text.select("file", "block", "bytes")), ["file", "block"]).select("file", (F.col("at") + F.col("base")).alias("at"), "value")
    return (text.join(inner.select("file", "at", "own"), ["file", "at"]).groupBy("file", "own")
            .agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
            .mapInArrow(_joined, "file string, own long, full_digest string, full_bytes long").withColumnRenamed("own", "at"))


def _placed(batches):
    """Offset of every segment in its byte range."""
    now, at = None, 0
    for b in batches:
        rows = []
        for file, block, value in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value"))):
            at = at if (file, block) == now else 0
            now, size = (file, block), len(value.encode())
            rows.append((file, block, at, size, value))
            at += size + len(MAGIC)
        yield from rows_table(rows, _PLACED).to_batches()


_PLACED = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("bytes", pa.int64()), ("value", pa.string())])


def warc_round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    folder = write_warc(pages, fresh_folder(spark, "warc"), min_revisit_bytes)
    return read_warc(spark, folder)
