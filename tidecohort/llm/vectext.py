"""Vectorised text primitives: whole Arrow batches of texts as flat byte, word and hash arrays.

A batch of texts is one byte buffer. Words and lines, which do not overlap, are hashed by an inner product of their bytes'
random numbers with a random number for each place (modulo 2**64): no pattern of bytes cancels, as it can in a polynomial.
Short substrings that do overlap (k-grams) get a polynomial by prefix sums. Both cost a few array operations and no Python
loop. Work is done per batch; long batches are split by bytes so that memory stays bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII byte that is no letter.
NO_LETTER = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])
_powers = {"base": np.ones(1, _U), "inverse": np.ones(1, _U)}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _power(kind: str, step: np.uint64, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        steps = np.full(max(n, 1 << 16), step, _U)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[kind] = np.multiply.accumulate(steps)
    return have[:n]


class Batch:
    """Texts (null counts as empty) as a byte buffer with document offsets and word positions."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string())
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
        self.n = len(texts)
        self.data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        lengths = np.diff(self.offsets)
        if texts.null_count:
            lengths = np.where(np.asarray(texts.is_null()), 0, lengths)
        self.lengths = lengths
        self._sums = None

    def words(self, separators: np.ndarray = SPACE) -> None:
        """Sets ``starts``, ``ends`` (byte positions), ``doc`` (document of each word) and ``first`` (first word of each document)."""
        space = separators[self.data]
        inside = ~space
        begins = inside.copy()
        begins[1:] &= space[:-1]
        edges = self.offsets[:-1][np.diff(self.offsets) > 0]
        begins[edges] = inside[edges]
        ends = inside.copy()
        ends[:-1] &= space[1:]
        last = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        ends[last] = inside[last]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))

    def segment_hashes(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        """64-bit hash of each of the byte ranges [start, end), which come in order and do not overlap; salts are independent."""
        if not len(starts):
            return np.zeros(0, _U)
        sizes = ends - starts
        inside = np.zeros(len(self.data) + 1, np.int64)
        begins = starts[sizes > 0]
        place = np.arange(len(self.data))
        inside[begins] = begins - np.concatenate([[0], begins[:-1]])
        place = place - np.cumsum(inside[:-1])
        sums = np.zeros(len(self.data) + 1, _U)
        with np.errstate(over="ignore"):
            weights = mix(np.arange(int(sizes.max()) + 1, dtype=_U) + _U(salt << 40)) | _U(1)
            np.cumsum(_TABLE[self.data] * weights[np.minimum(place, len(weights) - 1)], out=sums[1:])
            return mix(sums[ends] - sums[starts] + mix(sizes.astype(_U)))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each of the byte ranges [start, end); ranges may overlap and should be short (see above)."""
        if self._sums is None:
            n = len(self.data)
            sums = np.zeros(n + 1, _U)
            with np.errstate(over="ignore"):
                np.cumsum(_TABLE[self.data] * _power("base", _BASE, n), out=sums[1:])
            self._sums = sums
        with np.errstate(over="ignore"):
            return mix((self._sums[ends] - self._sums[starts]) * _power("inverse", _INVERSE, len(self.data) + 1)[starts])

    def word_hashes(self, salt: int = 0) -> np.ndarray:
        return self.segment_hashes(self.starts, self.ends, salt)


def shingles(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of the windows of ``k`` consecutive words of one document."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    out = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out * _BASE + hashes[i : i + n])
    whole = doc[:n] == doc[k - 1 :]
    return out[whole], doc[:n][whole]


def slices(table: pa.RecordBatch, column: str, most_bytes: int = 2 << 20):
    """The batch in pieces whose texts have about ``most_bytes`` together; a longer text is a piece of its own."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(table.column(column)), 0)).astype(np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most_bytes:
            yield table.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < len(sizes):
        yield table.slice(start)


def lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted hash in the sorted ``keys``; -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)
