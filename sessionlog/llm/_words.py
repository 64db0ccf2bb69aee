"""Vectorised words and hashes of whole texts, for use inside Arrow tasks.

Words are the runs of bytes other than space and 0x09-0x0D. Everything works on
the byte buffer of an Arrow string column, so a batch costs a few numpy passes
and no Python object per word.

Short words are hashed by a polynomial modulo 2^64 over random bytes' values. Such
polynomials have equal values at words of a thousand bytes and more that are built on
the Thue-Morse sequence, whatever the base, so words of more than LONG_WORD bytes
are hashed by BLAKE2 instead. Sums run over segments of bounded size, however
long a text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_M = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_Q = 0xD1342543DE82EF95
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_P)) | _U(1)
#: Words of more bytes are hashed by BLAKE2.
LONG_WORD = 32
#: Numbers that one sum runs over.
SEGMENT = 1 << 18


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < SEGMENT."""
    return tuple(np.multiply.accumulate(np.concatenate([[_U(1)], np.full(SEGMENT - 1, b, np.uint64)])) for b in (_U(base), _U(pow(base, -1, 1 << 64))))


_BYTE_POWERS, _WORD_POWERS = _powers(_P), _powers(_Q)


class Words:
    """The words of the texts of one chunk: byte spans, and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        space, n = SPACE[data], len(data)
        first, last = space.copy(), space.copy()
        first[1:], last[:-1] = space[:-1], space[1:]
        if n:
            first[0] = last[-1] = True
        first[offsets[:-1][offsets[:-1] < n]] = True
        last[offsets[1:][offsets[1:] > 0] - 1] = True
        word = ~space
        self.starts = np.flatnonzero(word & first)
        self.ends = np.flatnonzero(word & last) + 1
        #: Words of text i are first[i]:first[i + 1].
        self.first = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def split_stops(self) -> None:
        """Make full stops and commas at a word's end, after an ASCII letter, a word of their own."""
        d, size = self.data, self.ends - self.starts
        stop = (d == 0x2E) | (d == 0x2C)
        at = self.ends.copy()
        for _ in range(3):  # up to three of them; longer runs stay together with their word
            at -= (at - self.starts > 1) & stop[at - 1]
        before = d[at - 1] | 0x20
        at = np.where((at < self.ends) & (size > 1) & (before >= 97) & (before <= 122) & ~stop[at - 1], at, self.ends)
        cut = np.flatnonzero(at < self.ends)
        self.first = self.first + np.searchsorted(cut, self.first)
        self.starts, self.ends = np.insert(self.starts, cut + 1, at[cut]), np.sort(np.concatenate([self.ends, at[cut]]))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.zeros(len(self.starts), np.uint64)
        short = self.ends - self.starts <= LONG_WORD
        for i in np.flatnonzero(~short).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=8).digest(), "little")
        own = np.flatnonzero(short)
        starts, ends = self.starts[own], self.ends[own]
        up, down = _BYTE_POWERS
        i = 0
        while i < len(own):
            at = starts[i]
            j = int(np.searchsorted(ends, at + SEGMENT, "right"))
            part = self.data[at : ends[j - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
            out[own[i:j]] = mix((sums[ends[i:j] - at] - sums[starts[i:j] - at]) * down[starts[i:j] - at])
            i = j
        return out


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive hashes, by where they start."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    up, down = _WORD_POWERS
    for i in range(0, m, SEGMENT - n):
        part = hashes[i : i + SEGMENT - 1]
        k = len(part) - n + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[i : i + k] = mix((sums[n:] - sums[:k]) * down[:k] + _U(n))
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about `most` bytes of text each, a long text alone, with their bytes and offsets."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def strings(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each text's bytes."""
    raw, at = data.tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
