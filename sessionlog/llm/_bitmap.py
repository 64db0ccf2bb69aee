"""Bitmaps of 64-bit numbers, of a bounded size, to screen rows where they are read."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size bound of a broadcast bitmap, 32 MB; it has at least CELL_BITS bits for a number.
BITMAP_BITS = 1 << 28
CELL_BITS = 32
_BLOCK = 1 << 19


def bits_for(n: int) -> int:
    """A power of two of bits for n numbers."""
    return 1 << max(16, (n * CELL_BITS).bit_length())


def bitmap(cells: DataFrame, bits: int) -> np.ndarray:
    """The column cell as a bitmap, put together from blocks of 64 KB that tasks fill."""

    def block(part: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(min(_BLOCK, max(8, bits)), np.uint8)
        own[part["bit"].to_numpy() % _BLOCK] = 1
        return pd.DataFrame({"block": [int(part["bit"].iloc[0]) // _BLOCK], "held": [np.packbits(own, bitorder="little").tobytes()]})

    placed = cells.select(F.col("cell").bitwiseAND(F.lit(bits - 1)).alias("bit")).distinct()
    blocks = placed.groupBy(F.floor(F.col("bit") / _BLOCK).alias("block")).applyInPandas(block, "block long, held binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in blocks.toLocalIterator():  # bits / 8 bytes in all
        at = row["block"] * _BLOCK // 8
        out[at : at + len(row["held"])] = np.frombuffer(row["held"], np.uint8)
    return out


class Screen:
    """A broadcast bitmap of the column cell, of BITMAP_BITS at most: the more cells it must hold beyond its size, the more others pass."""

    def __init__(self, cells: DataFrame, most: int = BITMAP_BITS):
        self.bits = min(bits_for(cells.count()), most)
        self.table = cells.sparkSession.sparkContext.broadcast(bitmap(cells, self.bits))

    def __call__(self, cells: np.ndarray) -> np.ndarray:
        """Whether each number (uint64) may be among the cells; never false for one that is."""
        return held(self.table.value, self.bits, cells)


def held(table: np.ndarray, bits: int, cells: np.ndarray) -> np.ndarray:
    """Whether each number (uint64) may be in the bitmap; never false for one that is."""
    bit = cells & np.uint64(bits - 1)
    return (table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
