"""Shared numpy kernels over Arrow string columns, used inside Spark tasks.

A word is a maximal run of bytes other than space and TAB..CR (0x20, 0x09-0x0D). Those bytes never
occur inside a multi-byte UTF-8 character, so words are found on the raw UTF-8 buffer of a column
without decoding it. Hashes are polynomial over prefix sums modulo 2^64, so the hash of any run of
bytes or words is one subtraction and one multiplication. Checks mix each word's bytes eight at a time
and are polynomial modulo the prime 2^31 - 1 over words, so that two runs with equal hashes have equal
checks only by a second, independent chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NO_ID = np.iinfo(np.int64).max          # stands for a NULL doc_id: later than every real one

_BASE = 0x9E3779B97F4A7C15               # odd, hence invertible modulo 2^64
_KEPT = 1 << 21                          # powers that a worker keeps: 32 MB for both bases
_POWERS: list[np.ndarray] = []


def _power_rows(n: int) -> list[np.ndarray]:
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[:1] = 1
        out.append(np.cumprod(x))
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; a worker keeps those of a usual slice."""
    if n > _KEPT:
        return tuple(_power_rows(n))
    if not _POWERS:
        _POWERS.extend(_power_rows(_KEPT))
    return _POWERS[0][:n], _POWERS[1][:n]


def forget() -> None:
    """Drop the kept powers; the next slice makes them again."""
    _POWERS.clear()
    _CHECK_POWERS.clear()


_PRIME = (1 << 31) - 1
_CHECK_BASE = 0x4F6CDD1D
_CHECK_POWERS: list[np.ndarray] = []


def _check_rows(n: int) -> list[np.ndarray]:
    out = []
    for b in (_CHECK_BASE, pow(_CHECK_BASE, -1, _PRIME)):
        x = np.ones(n, np.uint64)
        done = 1
        while done < n:
            more = min(done, n - done)
            x[done:done + more] = x[:more] * np.uint64(pow(b, done, _PRIME)) % np.uint64(_PRIME)
            done += more
        out.append(x.astype(np.uint32))
    return out


def check_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the checks' base and of its inverse modulo the prime (31 bits each)."""
    if n > _KEPT:
        return tuple(_check_rows(n))
    if not _CHECK_POWERS:
        _CHECK_POWERS.extend(_check_rows(_KEPT))
    return _CHECK_POWERS[0][:n], _CHECK_POWERS[1][:n]


def check_prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums for ``run_check``; values below 2^31."""
    terms = values.astype(np.uint64, copy=False) * check_powers(len(values))[0]
    terms %= np.uint64(_PRIME)
    out = np.zeros(len(values) + 1, np.uint32)
    out[1:] = np.cumsum(terms, out=terms) % np.uint64(_PRIME)
    return out


def run_check(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial check (below 2^31) of values[start:end] for many runs."""
    p = np.uint64(_PRIME)
    return (pre[end] + p - pre[start]) % p * check_powers(len(pre))[1][start] % p


_LONG = 64                               # bytes from which a word's check is polynomial over its bytes


def word_checks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """31-bit check of the bytes of every word."""
    n = end - start
    if not len(n):
        return np.zeros(0, np.uint64)
    eights = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))

    def read(start, left):                # up to eight bytes
        return eights[start] << (64 - 8 * np.minimum(left, 8)).astype(np.uint64)
    out = read(start, n)
    todo, at = np.flatnonzero((n > 8) & (n < _LONG)), 8
    while len(todo):
        so_far = out[todo] * np.uint64(_BASE)
        so_far ^= so_far >> np.uint64(32)
        out[todo] = so_far + read(start[todo] + at, n[todo] - at)
        at += 8
        todo = todo[n[todo] > at]
    long = np.flatnonzero(n >= _LONG)
    if len(long):
        last = np.cumsum(n[long])
        byte = np.arange(last[-1]) + np.repeat(start[long] - last + n[long], n[long])
        out[long] = run_check(check_prefix(data[byte].astype(np.uint64) + np.uint64(1)), last - n[long], last)
    out *= np.uint64(_BASE)
    out += n.astype(np.uint64)
    return mix(out, 92) >> np.uint64(33)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply)."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums for ``run_hash``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64, copy=False) * _powers(len(values))[0], out=out[1:])
    return out


def run_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash (not yet mixed) of values[start:end] for many runs."""
    return (pre[end] - pre[start]) * _powers(len(pre))[1][start]


def slices(column: pa.Array, max_bytes: int = 2_000_000):
    """(start, stop) row ranges holding about ``max_bytes`` of text each; one long text is one range."""
    if not len(column):
        return
    off = offsets(column)[1]
    a = 0
    while a < len(column):
        b = int(np.searchsorted(off, off[a] + max_bytes, "right")) - 1
        b = min(max(b, a + 1), len(column))
        yield a, b
        a = b


def offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL is an empty text."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4))
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:                 # a NULL's range may hold left-over bytes: rebuild without them
        column = column.fill_null("")
        return offsets(pa.concat_arrays([column])) if column.null_count == 0 else (data, off)
    return data, off.astype(np.int64)


def flat(column) -> pa.Array:
    """One array from a possibly chunked column."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Words:
    """Words of a slice of texts.

    data: bytes; start, end: byte range of every word; first: index of each text's first word
    (one more entry than texts); hash: mixed 64-bit hash of every word.
    """

    def __init__(self, column: pa.Array, lower: bool = False, breaks: int | None = None):
        """``breaks``: a byte value (such as line feed) at which units begin anew, see ``unit``."""
        data, off = offsets(column)
        data = data[off[0]:off[-1]]
        off = off - off[0]
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data, self.off = data, off
        n = len(data)
        solid = ~SPACE[data]
        s, e = solid.copy(), solid.copy()
        if n:
            s[1:] &= ~solid[:-1]
            e[:-1] &= ~solid[1:]
            edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
            s[edge] = solid[edge]
            e[edge - 1] = solid[edge - 1]
        self.start = np.flatnonzero(s)
        self.end = np.flatnonzero(e) + 1
        self.first = np.searchsorted(self.start, off)
        self.hash = self._hash()
        self._check_prefix = None

    def _hash(self) -> np.ndarray:
        x = self.data.astype(np.uint64)
        x += np.uint64(1)
        pre = prefix(x)
        return mix(run_hash(pre, self.start, self.end) + (self.end - self.start).astype(np.uint64))

    def __len__(self):
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Text index of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, n: int, salt: int = 0):
        """(index of first word, text index, hash) of every run of n words inside one text."""
        doc = self.doc()
        i = np.flatnonzero(np.arange(len(self)) + n <= self.first[1:][doc]) if len(self) else np.zeros(0, np.int64)
        pre = prefix(self.hash)
        return i, doc[i], mix(run_hash(pre, i, i + n), salt)

    def spans_hash(self, a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hash of the word runs [a, b)."""
        return mix(run_hash(prefix(self.hash), a, b) + (b - a).astype(np.uint64), salt)

    @property
    def check_prefix(self) -> np.ndarray:
        """Prefix sums of the words' checks, made when first asked for."""
        if self._check_prefix is None:
            self._check_prefix = check_prefix(word_checks(self.data, self.start, self.end))
        return self._check_prefix

    def spans_check(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """31-bit check of the word runs [a, b), independent of ``spans_hash`` and ``windows``."""
        return ((run_check(self.check_prefix, a, b) + (b - a).astype(np.uint64)) % np.uint64(_PRIME)).astype(np.uint32)


def ids_of(column) -> np.ndarray:
    """An id column as int64, NULL as NO_ID."""
    c = flat(column).cast(pa.int64())
    return c.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def unblob(column, dtype) -> list[np.ndarray]:
    return [np.frombuffer(v.as_py(), dtype) for v in flat(column)]
