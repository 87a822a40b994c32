"""Vectorised text kernels over Arrow string columns: words, word hashes and n-gram hashes.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, never across two rows. A word's hash runs
its bytes, eight at a time, through two lanes that are mixed after every step (long words through keyed
BLAKE2b); an n-gram's hash mixes the hashes of its halves. So no pattern inside a word or a sequence
cancels out, as it would in a sum of powers. Hashes depend on the seed and on the bytes of a word, or on
the words of an n-gram, alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Bytes from which on a word goes through BLAKE2b.
LONG = 64
#: Of a word's last eight bytes, those that belong to it.
OWN = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def stirred(x: np.ndarray) -> np.ndarray:
    """A short mix between steps; in place."""
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """From each byte on, eight bytes as one number (zeros after the last)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray, roomy: bool = False) -> np.ndarray:
    """Whether ``a[at : at + size]`` and ``b[bt : bt + size]`` are equal, for each entry; a ``roomy`` b has eight
    bytes to spare at its end, and is not copied."""
    one, two = eights(a), np.ndarray(len(b) - 7, np.dtype("<u8"), b, strides=(1,)) if roomy else eights(b)
    out = ((one[at] ^ two[bt]) & OWN[np.minimum(size, 8)]) == 0
    for step in range(8, LONG, 8):
        live = np.flatnonzero(out & (size > step))
        if not len(live):
            return out
        out[live] = ((one[at[live] + step] ^ two[bt[live] + step]) & OWN[np.minimum(size[live] - step, 8)]) == 0
    for i in np.flatnonzero(out & (size > LONG)).tolist():
        out[i] = bool((a[at[i] : at[i] + size[i]] == b[bt[i] : bt[i] + size[i]]).all())
    return out


class Roller:
    """One hash family, given by its seed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.coef = rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
        self.lane = rng.integers(1, 1 << 63, 4, dtype=np.uint64) * U(2) + U(1)
        self.key = rng.bytes(32)

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each word ``data[start:end]``."""
        size = end - start
        eight = eights(data)
        left = np.full(len(start), self.lane[0], np.uint64)
        right = size.astype(np.uint64) * self.lane[1]
        live, at, rest = slice(None), start, size
        for step in range(LONG // 8):
            part = eight[at] & OWN[np.minimum(rest, 8)]
            left[live] = stirred((left[live] ^ part) * self.lane[2])
            right[live] = stirred((right[live] + part) * self.lane[3])
            more = np.flatnonzero((size > 8 * (step + 1)) & (size <= LONG))
            if not len(more):
                break
            live, at, rest = more, start[more] + 8 * (step + 1), size[more] - 8 * (step + 1)
        out = mix(left + (right ^ (right >> U(31))) * self.lane[1])
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=self.key).digest(), "little")
        return out

    def ngrams(self, w: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the ``len(w) - n + 1`` runs of n consecutive words (over a flat array)."""
        count = len(w) - n + 1
        if count <= 0:
            return np.empty(0, np.uint64)
        if n <= 8:
            h = w[:count] * self.coef[0]
            for k in range(1, n):
                h += w[k : k + count] * self.coef[k]
            return mix(h + U(n))
        out = np.empty(count, np.uint64)
        for i in range(0, count, SLICE):
            j = min(count, i + SLICE)
            h, size = w[i : j + n - 1], 1
            while 2 * size <= n:  # runs of a power of two words, from two halves
                h = stirred(h[:-size] * self.coef[0] + h[size:] * self.coef[size % 61 + 1])
                size *= 2
            out[i:j] = mix(h[: j - i] * self.coef[62] + h[n - size : n - size + j - i] * self.coef[63] + U(n))
        return out

    def short(self, w: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Hashes of whole sequences ``w[starts : starts + lengths]`` of at most 8 words."""
        h = np.zeros(len(starts), np.uint64)
        for k in range(int(lengths.max(initial=0))):
            has = lengths > k
            h[has] += w[starts[has] + k] * self.coef[k]
        return mix(h + lengths.astype(np.uint64))


class Words:
    """The words of a batch of texts: byte spans and the first word of each row."""

    __slots__ = ("data", "start", "end", "first")

    def __init__(self, data, start, end, first):
        self.data, self.start, self.end, self.first = data, start, end, first

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and row offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words_of(column: pa.Array, lower: bool = False, gap: np.ndarray = SPACE) -> Words:
    """The runs of bytes other than ``gap`` (a table by byte)."""
    data, at = text_buffer(column)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(gap[data], out=inside[1:-1])
    edge = inside[1:] != inside[:-1]
    # a row's end also ends a word that touches the next row's first
    cuts = at[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    touching = cuts[inside[cuts] & inside[cuts + 1]]
    bounds = np.flatnonzero(edge)
    if len(touching):
        bounds = np.sort(np.concatenate([bounds, touching, touching]))
    start, end = bounds[0::2], bounds[1::2]
    return Words(data, start, end, np.searchsorted(start, at))


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with ``counts`` entries: each entry's row, and its place in the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return row, np.arange(len(row)) - first[row]


def crc32_text(ids: np.ndarray) -> np.ndarray:
    import zlib

    return np.fromiter((zlib.crc32(b"%d" % i) for i in ids.tolist()), np.int64, len(ids))
