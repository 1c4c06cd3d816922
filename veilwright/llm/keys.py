"""Byte strings as numbers, looked up many at a time.

A string of at most ``WIDTH`` bytes is three numbers that hold its bytes and, in the byte that is left, a tag other than zero.
Strings with equal tags and numbers are equal, so nothing is decided by a hash alone."""

from __future__ import annotations

import numpy as np

WIDTH = 23
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
# By length: which bits of the three numbers are bytes of the string.
MASKS = np.array([[(1 << 8 * min(max(n - at, 0), 8)) - 1 for at in (0, 8, 16)] for n in range(WIDTH + 1)], np.uint64).T.copy()


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for ``n`` rows."""
    if n <= len(x):
        return x
    out = np.zeros((n + n // 2, *x.shape[1:]), x.dtype)
    out[:len(x)] = x
    return out


def keys_of(data: bytes, start: np.ndarray, length: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """The three numbers of strings in ``data``; all zero, which is no key, where a string is longer than ``WIDTH``."""
    short = length <= WIDTH
    n = np.where(short, length, 0)
    numbers = np.frombuffer(data + bytes(40 - len(data) % 8), "<u8")
    place, shift = start >> 3, ((start & 7) << 3).astype(np.uint64)
    back = np.uint64(63) - shift
    near = [numbers[place + i] for i in range(4)]
    keys = np.empty((len(start), 3), np.uint64)
    for i in range(3):
        keys[:, i] = ((near[i] >> shift) | ((near[i + 1] << np.uint64(1)) << back)) & MASKS[i][n]
    keys[:, 2] |= np.where(short, tag, 0).astype(np.uint64) << np.uint64(56)
    return keys


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where a new one begins in it."""
    order = np.lexsort(keys.T)
    return order, np.concatenate(([True], (keys[order[1:]] != keys[order[:-1]]).any(axis=1)))[:len(keys)]


class KeyTable:
    """Numbers of entries by key: 0, 1, 2, ... as they are added. ``again``: entries that were met since."""

    def __init__(self) -> None:
        self.n = 0
        self.keys = np.zeros((1 << 10, 3), np.uint64)
        self.again = np.zeros(1 << 10, bool)
        self.slots = np.full(1 << 12, -1, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys @ SPREAD
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * SPREAD[0]) >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's entry, -1 if there is none."""
        found = np.full(len(keys), -1, np.int64)
        slot, open_ = self._place(keys), np.arange(len(keys))
        while len(open_):
            entry = self.slots[slot].astype(np.int64)
            taken = entry >= 0
            slot, open_, entry = slot[taken], open_[taken], entry[taken]
            same = (self.keys[entry] == keys[open_]).all(axis=1)
            found[open_[same]] = entry[same]
            slot, open_ = (slot[~same] + 1) & (len(self.slots) - 1), open_[~same]
        self.again[found[found >= 0]] = True
        return found

    def add(self, keys: np.ndarray) -> np.ndarray:
        """New entries for different keys that have none. Entries with keys of zeros are not found by key."""
        new = np.arange(self.n, self.n + len(keys))
        self.n += len(keys)
        self.keys, self.again = grown(self.keys, self.n), grown(self.again, self.n)
        self.keys[new], self.again[new] = keys, False
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << (4 * self.n).bit_length(), -1, np.int32)
            self._enter(np.arange(self.n))
        else:
            self._enter(new)
        return new

    def _enter(self, entry: np.ndarray) -> None:
        entry = entry[self.keys[entry, 2] > 0]
        slot = self._place(self.keys[entry])
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            left = self.slots[slot] != entry
            entry, slot = entry[left], (slot[left] + 1) & (len(self.slots) - 1)

    def met_again(self) -> np.ndarray:
        return np.flatnonzero(self.again[:self.n] & (self.keys[:self.n, 2] > 0))
