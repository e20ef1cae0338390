"""Text primitives for Arrow batches: words, digests, rolling hashes, window minima.

All functions work on one byte buffer that holds many whole texts. Equality is decided by content or
by a digest of it (BLAKE2b). Rolling hashes are polynomials modulo 2**64 with an odd base and are weak on
purpose-made strings: they choose and route (anchors, buckets), and never decide that two texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa

# Workers are kept for later stages; what a batch took should go back to the system, not stay in a pool.
pa.set_memory_pool(pa.system_memory_pool())

#: Bytes of text that are held in numpy arrays at a time; one longer text is taken alone, whole.
SLICE_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.RandomState(20240229).randint(1, 1 << 62, 256).astype(np.uint64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown when asked for more."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


class Rolling:
    """Prefix sums over a sequence of uint64 values; hash of [start, end) in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(_BASE, n), out=self.prefix[1:])
        self.inverse = powers(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all runs of k values."""
        m = len(self.prefix) - k
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[k:] - self.prefix[:m]) * self.inverse[:m])


def text_slices(ids: pa.Array, texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of at most ``limit`` bytes (one row at least).

    Yields the ids, the bytes of the texts and their offsets (from 0, one more than rows). A null
    text is empty.
    """
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, count=n + 1, offset=texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield ids.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For bytes.translate: A-Z in lower case, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.frombuffer(data.tobytes().translate(LOWER), np.uint8)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words [^\\x20\\x09-\\x0D]+, and row splits by text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_VALUES = _BYTE_VALUES.copy()


#: Words of more bytes are hashed by a digest, one by one.
_LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One uint64 for each word, all words at once: their bytes by eights, mixed in one after the other.

    Each step is a bijection of the state and of the bytes, and not linear, so that no sums of terms can cancel out.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    eights = np.zeros(len(data) // 8 + 3, np.uint64)
    eights.view(np.uint8)[: len(data)] = data
    size = ends - starts
    h = mix(size.astype(np.uint64) + np.uint64(_BASE))
    word = np.flatnonzero(size <= _LONG_WORD)
    at, left = starts[word], size[word]
    while len(word):
        cell, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        # A shift by 64 bits is made in two steps.
        x = (eights[cell] >> shift) | ((eights[cell + 1] << (np.uint64(63) - shift)) << np.uint64(1))
        short = np.flatnonzero(left < 8)
        x[short] &= (np.uint64(1) << (left[short] << 3).astype(np.uint64)) - np.uint64(1)
        h[word] = mix((h[word] ^ x) * np.uint64(_BASE))
        on = np.flatnonzero(left > 8)
        word, at, left = word[on], at[on] + 8, left[on] - 8
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        h[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


class Words:
    """The words of a block of texts: hashes, row splits, and the texts with one space between words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.rows = word_bounds(data, offsets)
        self._found = data, starts, ends
        # Keep the words and the byte behind each, if it lies in the block; that of another text is never looked at.
        keep = np.zeros(len(data) + 1, np.int8)
        keep[starts] += 1
        keep[ends] -= 1
        inside = np.cumsum(keep[:-1], dtype=np.int8).view(bool)
        behind = ends[ends < len(data)]
        kept = inside.copy()
        kept[behind] = True
        self.raw = np.where(inside, data, np.uint8(32))[kept].tobytes()
        place = np.cumsum(kept) - kept
        self.starts = place[starts]
        self.ends = self.starts + (ends - starts)

    @cached_property
    def hashes(self) -> np.ndarray:
        return word_hashes(*self._found)

    def cut(self, first: np.ndarray, end: np.ndarray) -> list[bytes]:
        """Runs of words [first, end) of one text each, joined by single spaces; an empty run gives no bytes."""
        raw = self.raw
        filled = np.flatnonzero(end > first)
        if len(filled) < len(first):
            out = [b""] * len(first)
            for i, x in zip(filled.tolist(), self.cut(first[filled], end[filled]), strict=True):
                out[i] = x
            return out
        return [raw[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[end - 1].tolist(), strict=True)]

    def texts(self) -> list[bytes]:
        return self.cut(self.rows[:-1], self.rows[1:])


def digests(pieces: list[bytes]) -> np.ndarray:
    """One uint64 for each piece of text, by a digest of its bytes."""
    return np.frombuffer(b"".join([blake2b(x, digest_size=8).digest() for x in pieces]), np.uint64)


def byte_rolling(data: np.ndarray) -> Rolling:
    """Substring hashes of a byte buffer."""
    return Rolling(_VALUES[data])


def window_argmin(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest hash (the first on ties) in each window of ``width`` hashes.

    Compares the upper 32 bits of the hashes; the choice depends on the window's content alone. Minima of
    windows of 2, 4, 8 and so on hashes; two of the last that fits cover the window.
    """
    n = len(hashes)
    m = n - width + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    key = hashes & ~low
    key |= np.arange(n, dtype=np.uint64)
    w = 1
    while 2 * w <= width:
        key = np.minimum(key[:-w], key[w:])
        w *= 2
    if w < width:
        key = np.minimum(key[:m], key[width - w : width - w + m])
    return (key & low).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long."""
    return x.view(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
