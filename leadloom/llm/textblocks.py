"""Words of many texts at once, as numpy arrays over Arrow's string buffers.

A *block* is a run of whole texts of about ``BLOCK_BYTES`` (one text alone if it is longer), so that
the work arrays stay small however many rows an Arrow batch holds.  Words are the runs of bytes
other than space and 0x09-0x0D, i.e. ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def mix_int(x: int) -> int:
    """``mix`` of one Python integer."""
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=_U))[0])


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    step, back = np.full(n, _BASE, dtype=_U), np.full(n, pow(_BASE, -1, 1 << 64), dtype=_U)
    step[0] = back[0] = 1
    return np.cumprod(step), np.cumprod(back)


@dataclass
class Block:
    """``first``: the number of the block's first row; ``data``, ``bounds``: the texts' bytes and their limits."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def blocks(texts: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The blocks of a string array; a null text is an empty one."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        b = min(b, n)
        part = data[offsets[a] : offsets[b]]
        yield Block(a, _LOWER[part] if lower else part, offsets[a : b + 1] - offsets[a])
        a = b


@dataclass
class Words:
    """``start``, ``end``: byte limits of each word; ``doc``: its text's number in the block; ``counts``: words of each text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    counts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """For each text the number of its first word, and at last the number of all words."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def words(block: Block, space: np.ndarray = _SPACE) -> Words:
    """The words of a block; ``space`` tells of each byte whether it stands between words."""
    data, bounds = block.data, block.bounds
    solid = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    limits = np.searchsorted(start, bounds)
    counts = np.diff(limits)
    return Words(start, end, np.repeat(np.arange(block.rows), counts), counts)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the bytes stand."""
    if not len(start):
        return np.zeros(0, dtype=_U)
    size = 1 << max(12, int(len(data)).bit_length())
    power, back = _powers(size)
    sums = np.empty(len(data) + 1, dtype=_U)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(_U))


def word_hash(word: str) -> int:
    """The hash that ``span_hashes`` gives ``word``, as a signed 64-bit integer."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)])).view(np.int64)[0])


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` values from each place on, for places 0 to len - n."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=_U)
    power, back = _powers(1 << max(12, len(hashes).bit_length()))
    sums = np.empty(len(hashes) + 1, dtype=_U)
    sums[0] = 0
    np.cumsum(mix(hashes) * power[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:m]) * back[:m] + _U(n))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list array whose rows hold ``counts`` of the ``values``."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
