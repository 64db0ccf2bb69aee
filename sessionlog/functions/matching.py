"""Many strings sought in many texts at once."""

from __future__ import annotations

import numpy as np

_HEAD = 8
_TABLE = 20


class Finder:
    """Finds every place of every string of a list in bytes, in one pass over them, whatever their shape.

    Each string is known by its anchor, the run of eight bytes inside it that the
    fewest others of the list hold, so that a beginning they all share costs nothing.
    The runs of a text are looked up as numbers: a table of bits first, then the sorted
    anchors; where one stands, the whole string is compared. Strings of less than
    eight bytes have anchors of their own length. Memory is a few numbers a string.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = sorted(set(strings) - {b""})
        self.kinds = []
        for width in range(1, _HEAD + 1):
            own = [i for i, s in enumerate(self.strings) if min(len(s), _HEAD) == width]
            if not own:
                continue
            lengths = np.array([len(self.strings[i]) for i in own])
            codes = self._codes(b"".join(self.strings[i] for i in own), width)
            starts = np.cumsum(lengths) - lengths
            n = lengths - width + 1
            at = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            _, which, held = np.unique(codes[at], return_inverse=True, return_counts=True)
            first = np.cumsum(n) - n
            offset = np.array([int(held[which[a : a + m]].argmin()) for a, m in zip(first, n, strict=True)])
            anchors = codes[starts + offset]
            order = np.argsort(anchors, kind="stable")
            bits = np.zeros(1 << _TABLE, bool)
            bits[self._slot(anchors)] = True
            self.kinds.append((width, bits, anchors[order], offset[order], np.array(own)[order]))

    @staticmethod
    def _codes(data: bytes, width: int) -> np.ndarray:
        """Each run of `width` bytes as a number, by where it starts."""
        if len(data) < width:
            return np.zeros(0, np.uint64)
        n = len(data) - width + 1
        raw = np.ndarray((n,), "<u8", data + bytes(_HEAD), strides=(1,))
        return raw & np.uint64((1 << 8 * width) - 1) if width < _HEAD else raw.copy()

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _TABLE)).astype(np.int64)

    def counts(self, data: bytes) -> dict[int, int]:
        """How many places each string has, by its number; overlapping places count."""
        out: dict[int, int] = {}
        for width, bits, anchors, offsets, own in self.kinds:
            codes = self._codes(data, width)
            maybe = np.flatnonzero(bits[self._slot(codes)])
            low, high = np.searchsorted(anchors, codes[maybe]), np.searchsorted(anchors, codes[maybe], "right")
            hit = np.flatnonzero(high > low)
            for at, a, b in zip(maybe[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                for k in range(a, b):
                    i, start = int(own[k]), at - int(offsets[k])
                    if start >= 0 and data.startswith(self.strings[i], start):
                        out[i] = out.get(i, 0) + 1
        return out
