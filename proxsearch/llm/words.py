"""Words of whole texts as 64-bit hashes, vectorised over an Arrow column.

A word is a run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

_U = np.uint64
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Start, and multipliers, of two independent hashes.
_STREAMS = ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (0xD1B54A32D192ED03, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
_MASK = (1 << 64) - 1
#: Bytes of text handled at once; a longer text is handled alone, whole.
CHUNK = 2 << 20


def mix(x: np.ndarray, stream: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    _, first, second = _STREAMS[stream]
    x = x ^ (x >> _U(30))
    x *= _U(first)
    x ^= x >> _U(27)
    x *= _U(second)
    x ^= x >> _U(31)
    return x


@dataclass
class Words:
    """Words of consecutive texts: text i has those from ``first[i]`` to ``first[i + 1]``."""

    row: int
    first: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    raw: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    def text(self, k: int) -> bytes:
        return self.raw[self.starts[k] : self.ends[k]].tobytes()

    @cached_property
    def second(self) -> np.ndarray:
        """Hashes of the words that are independent of ``hashes``."""
        return word_hashes(self.raw, self.starts, self.ends, 1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, stream: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, 8 bytes a step, all words side by side; no sum or polynomial of the bytes.

    Words of at most 8 bytes differ in it if they are as long as each other.
    """
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    lanes = np.lib.stride_tricks.sliding_window_view(padded, 8)
    size = ends - starts
    out = size.astype(np.uint64) * _U(_STREAMS[stream][0])
    at = np.arange(len(starts))
    step = 0
    while len(at):
        lane = np.ascontiguousarray(lanes[starts[at] + step]).view("<u8")[:, 0] & _MASKS[np.minimum(size[at] - step, 8)]
        out[at] = mix(out[at] ^ lane, stream)
        step += 8
        at = at[size[at] > step]
    return out


def words(texts: pa.Array, fold: bool = False) -> Iterator[Words]:
    """``texts``, without nulls, in chunks of near CHUNK bytes; ``fold``: A-Z count as a-z."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw_all = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + CHUNK, "right")) - 1)
        raw = raw_all[offs[row] : offs[to]]
        yield _chunk(row, _LOWER[raw] if fold else raw, offs[row : to + 1] - offs[row])
        row = to


def _chunk(row: int, raw: np.ndarray, offs: np.ndarray) -> Words:
    n = len(raw)
    white = _IS_WHITE[raw]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.ones(n, bool)
    before[1:] = white[:-1]
    starts = np.flatnonzero(~white & (before | cut[:n]))
    after = np.ones(n, bool)
    after[:-1] = white[1:]
    ends = np.flatnonzero(~white & (after | cut[1:])) + 1
    return Words(row, np.searchsorted(starts, offs), word_hashes(raw, starts, ends), starts, ends, raw)


def grams(hashes: np.ndarray, n: int, seed: int, stream: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words, mixed at every step, so that no arithmetic of runs shows in it."""
    left = _U(0xD6E8FEB86659FD93 * (2 * seed + 1) & _MASK | 1)
    have, width = hashes, 1
    # doubling: the hash of 2k words from two hashes of k words
    for bit in bin(n)[3:]:
        have = mix(have[: max(0, len(have) - width)] * left + have[width:] + _U(width), stream)
        width *= 2
        if bit == "1":
            count = max(0, len(have) - 1)
            have = mix(have[:count] * left + hashes[width : width + count] + _U(width), stream)
            width += 1
    count = max(0, len(hashes) - n + 1)
    return mix(have[:count] ^ _U(seed), stream)
