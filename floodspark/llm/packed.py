"""Compressed columns: whole numbers and lists of byte strings as one binary value each."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism

TASK_BYTES = 32 << 20                     # text that one task of an exchange stands for


@lru_cache(maxsize=1)
def _zstd():
    import zstandard
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def squeeze(raw: bytes) -> bytes:
    return _zstd()[0].compress(raw)


def expand(packed: bytes) -> bytes:
    return _zstd()[1].decompress(packed)


def pack_numbers(x: np.ndarray, width: int = 4) -> bytes:
    """Non-negative numbers of ``width`` bytes, equal bytes of all numbers together, compressed."""
    x = np.ascontiguousarray(x, f"<u{width}")
    return squeeze(x.view(np.uint8).reshape(-1, width).T.tobytes())


def unpack_numbers(packed: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(expand(packed), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def pack_strings(values: list[bytes]) -> bytes:
    n = np.fromiter(map(len, values), np.uint32, len(values))
    return squeeze(len(values).to_bytes(8, "little") + n.tobytes() + b"".join(values))


def unpack_strings(packed: bytes) -> list[bytes]:
    raw = expand(packed)
    n = int.from_bytes(raw[:8], "little")
    end = 8 + 4 * n + np.r_[0, np.cumsum(np.frombuffer(raw, np.uint32, n, 8).astype(np.int64))]
    return [raw[a:b] for a, b in zip(end[:-1].tolist(), end[1:].tolist())]


def pack_ids(lists: list[bytes]) -> bytes:
    """Lists of 32-bit ids: sizes, then ids."""
    sizes = pack_numbers(np.fromiter(map(len, lists), np.uint32, len(lists)) // 4)
    return len(sizes).to_bytes(8, "little") + sizes + pack_numbers(np.frombuffer(b"".join(lists), "<u4"))


def unpack_ids(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = 8 + int.from_bytes(packed[:8], "little")
    return unpack_numbers(packed[8:n]).astype(np.int64), unpack_numbers(packed[n:])


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + size[i] - 1 of all i in a row."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


class Numbering:
    """Numbers of the slices of a task: the partition's number and a running one, the same on a retry."""

    def __init__(self):
        context = TaskContext.get()
        self.next = (context.partitionId() if context else 0) << 32

    def __call__(self) -> int:
        self.next += 1
        return self.next - 1


def exchange_width(docs: DataFrame) -> int:
    """Tasks (and buckets) of an exchange of the texts: by their bytes, the session's shuffle width at least."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0      # one number
    return max(parallelism(docs.sparkSession), -(-int(size) // TASK_BYTES))


def rows_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def row_batch(row: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)
