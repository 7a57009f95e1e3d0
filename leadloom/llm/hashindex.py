"""A read-only map from 64-bit integers to places, looked up for whole arrays at once."""

from __future__ import annotations

import numpy as np

from .textblocks import mix

_U = np.uint64


class HashIndex:
    """``find(x)``: for each value its place in ``keys`` (all different), or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.view(_U)
        size = 1 << (4 * max(1, len(keys))).bit_length()
        self.mask = size - 1
        self.slots = np.full(size, -1, np.int32)
        rest, at = np.arange(len(keys), dtype=np.int32), self._home(self.keys)
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]
            placed = self.slots[at] == rest
            rest, at = rest[~placed], (at[~placed] + 1) & self.mask

    def _home(self, values: np.ndarray) -> np.ndarray:
        return (mix(values) & _U(self.mask)).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(values), -1, np.int32)
        values = values.view(_U)
        at = self._home(values)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != values))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = self.slots[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[out[open_]] != values[open_])]
        return out
