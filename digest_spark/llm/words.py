"""Words of whole texts and hashes of their affixes and n-grams, without a Python step per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from digest_spark.llm.arrowtext import HIGH, LETTER, byte_classes, column_bytes

WORDLIKE = np.isin(byte_classes(), (LETTER, HIGH))
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of 64-bit values."""
    x = (x + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """Runs of letters and non-ASCII characters, lower-cased, of a column of texts."""

    eights: np.ndarray  # eights[8 + i]: the eight bytes from i on
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray  # the text that each word is from
    rows: int

    def prefix(self, k: int) -> np.ndarray:
        """The first k bytes (the whole word if it is shorter)."""
        return self.eights[self.starts + 8] & MASKS[np.minimum(self.ends - self.starts, k)]

    def suffix(self, k: int) -> np.ndarray:
        n = np.minimum(self.ends - self.starts, k).astype(np.uint64)
        return np.where(n == 8, self.eights[self.ends], self.eights[self.ends] >> (np.uint64(64) - np.uint64(8) * n))

    def whole(self) -> np.ndarray:
        """A hash of each word, by its length and its first and last eight bytes."""
        return mixed(self.prefix(8) ^ mixed(self.suffix(8), 1), 2) + (self.ends - self.starts).astype(np.uint64)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, k bytes) for every place inside a word where k bytes fit."""
        n = np.maximum(self.ends - self.starts - k + 1, 0)
        word = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        return word, self.eights[self.starts[word] + place + 8] & MASKS[k]


def words_in(texts: pa.Array) -> Words:
    data, offsets = column_bytes(pc.utf8_lower(texts))
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = WORDLIKE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:n]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    padded = np.zeros(n + 24, np.uint8)
    padded[8 : n + 8] = data
    eights = np.ndarray((n + 16,), "<u8", padded, 0, (1,))
    return Words(eights, starts, ends, np.searchsorted(offsets, starts, "right") - 1, len(offsets) - 1)
