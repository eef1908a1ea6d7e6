"""Vectorised word splitting and hashing over Arrow string batches.

A batch of texts is handled as one byte buffer with offsets, so the work for a
word is a few numpy operations and no Python object. A word is a run of bytes
of one class; the classes used here depend on single bytes only, and every byte
of a multi-byte UTF-8 character is a word byte, so byte runs are exactly the
character runs of the patterns below. Hashes have 64 bits and are the same in
every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; a longer text makes a slice of its own.
SLICE_BYTES = 2 << 20
#: Rows that Spark should send to a Python worker at once; both sides hold a batch whole, and texts are long.
BATCH_ROWS = 1000
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = U(0x9E3779B97F4A7C15)

#: ``[^\x20\x09-\x0D]+``
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[32, 9, 10, 11, 12, 13]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z and everything outside ASCII.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True


def give_back() -> None:
    """Returns memory that is free to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def group(f):
    """A function of the rows of a group that gives back what it used."""

    def run(rows):
        try:
            return f(rows)
        finally:
            give_back()

    return run


def task(*steps: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """Steps over the batches of a task, one after the other in the same Python worker.

    Workers outlive their tasks; what a task used is given back at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for step in steps:
                batches = step(batches)
            yield from batches
        finally:
            batches = iter(())
            give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(29))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


@dataclass
class Words:
    """The words of some texts: byte ranges, the text each is in, and hashes."""

    buf: np.ndarray  # bytes, lower-cased if asked for
    off: np.ndarray  # where each text starts, and the end of the last
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # index of the text, per word
    first: np.ndarray  # index of each text's first word, and the number of words
    _hash: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_ranges(self.buf, self.start, self.end)
        return self._hash

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of every run of ``width`` words inside one text."""
        n = len(self.start) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        h = self.hash
        x = np.full(len(at), U(width))
        for k in range(width):
            x = x * _BASE + h[at + k]
        return at, mix(x)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    if col.null_count or not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece holds about ``limit`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    _, off = buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        to = min(batch.num_rows, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def split(col: pa.Array, classes: np.ndarray = SPACE_WORDS, lower: bool = False) -> Words:
    """The words of every text of a string array."""
    buf, off = buffers(col)
    if lower:
        buf = buf + (((buf >= 65) & (buf <= 90)).astype(np.uint8) << 5)
    return split_buffer(buf, off, classes)


def split_buffer(buf: np.ndarray, off: np.ndarray, classes: np.ndarray) -> Words:
    inside = np.zeros(len(buf) + 2, dtype=bool)
    inside[1:-1] = classes[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(buf, off, start, end, doc, first)


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray, prefixes: tuple[int, ...] = ()):
    """Hash of each byte range; with ``prefixes``, also of each range's first so many bytes (0 where it is shorter)."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    at, size = start[order], length[order]
    h = np.zeros(len(start), U)
    got = {}
    longest = int(size[0]) if len(size) else 0
    left = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    for k in range(longest):
        n = left[k]
        h[:n] = (h[:n] + _TABLE[buf[at[:n] + k]]) * _BASE
        if k + 1 in prefixes:
            p = np.zeros(len(start), U)
            p[order[:n]] = mix(h[:n] + U(k + 1))
            got[k + 1] = p
    out = np.zeros(len(start), U)
    out[order] = mix(h)
    if prefixes:
        return out, {k: got.get(k, np.zeros(len(start), U)) for k in prefixes}
    return out


def doc_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (per word) for each text."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def covered(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of ``n`` positions lie in one of the ranges."""
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, start + length, -1)
    return np.cumsum(delta[:n]) > 0
