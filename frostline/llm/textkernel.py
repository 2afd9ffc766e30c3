"""NumPy kernels over Arrow text batches: words, word hashes, window hashes, minimizers.

Everything works on UTF-8 bytes.  The separators are ASCII, so a word is the same run of bytes as of characters.
Hashes are 64-bit: a polynomial over the ring modulo 2**64, computed from prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
_BASE, _WINDOW_BASE = 0x9E3779B97F4A7C55, 0xD6E8FEB86659FD93
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        if size > 4 * SLICE_BYTES:  # a very long text: not kept
            return out[0], out[1]
        have = _POWERS[base] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that low and high bits are equally good."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of a run of documents.  ``first[d]:first[d+1]`` are document d's; start/end are byte offsets in data."""

    n: int
    data: np.ndarray
    offset: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    h: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """Per document, the sum of a per-word figure."""
        s = np.concatenate([[0], np.cumsum(per_word)])
        return s[self.first[1:]] - s[self.first[:-1]]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n+1 offsets from 0) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    d = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[o[0] : o[-1]]
    return d, o - o[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` text bytes (a longer text is a run of its own)."""
    _, off = buffers(batch.column(column))
    row, n = 0, batch.num_rows
    while row < n:
        end = int(np.searchsorted(off, off[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield batch.slice(row, end - row)
        row = end


def words(texts: pa.Array, lower: bool = False, hashes: bool = True) -> Words:
    data, off = buffers(texts)
    n, size = len(off) - 1, len(data)
    if lower and size:
        data = _LOWER[data]
    inside = ~_SEP[data]
    before = np.empty(size + 1, bool)
    before[1:] = inside
    before[off] = False
    after = np.empty(size + 1, bool)
    after[:-1] = inside
    after[off] = False
    start = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    first = np.searchsorted(start, off)
    h = np.zeros(0, np.uint64)
    if hashes and len(start):
        p, inv = _powers(_BASE, size + 1)
        s = np.empty(size + 1, np.uint64)
        s[0] = 0
        np.cumsum(_VALUE[data] * p[:size], out=s[1:])
        h = mix((s[end] - s[start]) * inv[start] + (end - start).astype(np.uint64) * U(0xA24BAED4963EE407))
    return Words(n, data, off, start, end, first, h)


def windows(w: Words, k: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of k words inside one document."""
    h = w.h if h is None else h
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last_of_doc = np.repeat(w.first[1:], np.diff(w.first))
    at = np.flatnonzero(np.arange(m) + k <= last_of_doc[:m])
    return at, rolling(h, k)[at]


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries, wherever documents end."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    p, inv = _powers(_WINDOW_BASE, len(h) + 1)
    s = np.empty(len(h) + 1, np.uint64)
    s[0] = 0
    np.cumsum(h * p[: len(h)], out=s[1:])
    return mix((s[k:] - s[:m]) * inv[:m] + U(k))


def sliding(x: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    """op over every ``width`` consecutive entries, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def minimizers(w: Words, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the k-word phrases that are the least-hashed of some run of ``span`` words.

    Any two equal runs of ``span`` words select the same phrase inside, so no recurring run is missed.
    All of several equal phrases are selected.  Documents shorter than ``span`` words select nothing.
    """
    per = span - k + 1
    g = rolling(w.h, k)
    m = len(w.h) - span + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding(g, per)
    last_of_doc = np.repeat(w.first[1:], np.diff(w.first))
    least = np.where(np.arange(m) + span <= last_of_doc[:m], least, U(0))
    pad = np.zeros(per - 1, np.uint64)
    top = sliding(np.concatenate([pad, least, pad]), per, np.maximum)
    at = np.flatnonzero((top == g) & (g != 0))
    return at, g[at]


def rotated(h: np.ndarray) -> np.ndarray:
    return (h << U(31)) | (h >> U(33))
