"""Vectorised word scanning over Arrow string columns.

Texts of a batch are looked at as one byte buffer. Word boundaries come from a
256-entry byte class table and word identities from a 64-bit polynomial hash
taken by prefix sums, so the cost is a few nanoseconds a byte and no Python
string is made for any word. Memory is bounded by ``CHUNK_BYTES`` of text at a
time (one text at least) and by ``CHUNK_ROWS`` texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes and rows looked at in one go; a single longer text is taken whole.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 4096

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if size <= 4 * CHUNK_BYTES:
            _powers[name] = known
    return known


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n + 1 offsets into them; nulls count as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, most: int = 0) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``CHUNK_BYTES`` of the column's text each."""
    most = most or CHUNK_BYTES
    if not batch.num_rows:
        return
    _, ends = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = min(start + CHUNK_ROWS, max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1))
        yield batch.slice(start, stop - start)
        start = stop


def separators(keep) -> np.ndarray:
    """Byte table: true where a byte isn't part of a word."""
    return np.array([not keep(b) for b in range(256)])


#: Words are runs of anything but ASCII white space.
SPACED = separators(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = separators(lambda b: b >= 0x80 or chr(b).isalnum())
#: Identity, and A-Z to a-z.
SAME = np.arange(256, dtype=np.uint8)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


class Words:
    """The words of some texts: start, end (byte positions) and doc (row) of each."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, apart: np.ndarray, fold: np.ndarray = SAME):
        self.buf, self.offsets, self.fold = buf, offsets, fold
        n = len(buf)
        inside = ~apart[buf]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges] = False
        after[edges - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.n_docs = len(offsets) - 1
        self._sums: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit identities of byte spans after folding; the same in every task."""
        n = len(self.buf)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.fold[self.buf]] * _power("odd", _ODD, n)[:n], out=self._sums[1:])
        h = (self._sums[end] - self._sums[start]) * _power("inv", _INV, n + 1)[start]
        return mix(h + (end - start).astype(np.uint64) * _ODD)

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def per_doc(self, weights: np.ndarray | None = None) -> np.ndarray:
        """Words, or sums of weights, by text."""
        got = np.bincount(self.doc, weights, self.n_docs)
        return got if weights is not None else got.astype(np.int64)


def runs(h: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Identities and first positions of all runs of ``length`` words inside one text."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[length - 1 :])
    got = h[at].copy()
    for k in range(1, length):
        got = mix(got * _ODD + h[at + k])
    return got, at


def covered(total: int, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Mask of positions inside any [start, start + length)."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + length, -1)
    return np.cumsum(steps[:-1]) > 0
