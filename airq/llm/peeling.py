"""Three-slot hypergraphs whose edges can be peeled, and what is built on them.

Each 64-bit key owns one slot in each of three consecutive segments of a table.
If keys can be removed one after another, each through a slot that only it still
owns, the slots can be filled in reverse order so that a function of a key's
three slots has any chosen value. That gives a static filter (the value is a
fingerprint of the key) and a minimal perfect hash (the value says which of the
three slots is the key's own). Peeling runs in rounds of numpy operations.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from airq.llm.rolling import mix

TRIES = 200


class Shape(NamedTuple):
    """Where keys find their slots: ``segments`` starting segments of ``width`` slots."""

    seed: int
    width: int
    segments: int

    @property
    def slots(self) -> int:
        return self.width * (self.segments + 2)


def shape_for(n: int, seed: int) -> Shape:
    """About 1.13 slots per key for many keys, more for few."""
    width = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 4)))
    segments = max(1, -(-int(n * factor) // width) - 2)
    return Shape(seed, width, segments + (seed > 100) * segments)


def slots_of(keys: np.ndarray, shape: Shape) -> np.ndarray:
    """The three slots of every key, as a 3 x n array."""
    h = mix(keys ^ mix(np.uint64(shape.seed + 1) * np.ones(1, dtype=np.uint64)))
    first = ((h >> np.uint64(32)) * np.uint64(shape.segments)) >> np.uint64(32)
    base = first.astype(np.int64) * shape.width
    inside = np.uint64(shape.width - 1)
    g = mix(h)
    return np.stack([
        base + (g & inside).astype(np.int64),
        base + shape.width + ((g >> np.uint64(20)) & inside).astype(np.int64),
        base + 2 * shape.width + ((g >> np.uint64(40)) & inside).astype(np.int64),
    ])


def _peeled(slots: np.ndarray, n_slots: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, which of their slots they own alone), or None if keys are left."""
    n = slots.shape[1]
    owners = np.bincount(slots.ravel(), minlength=n_slots)
    index = np.arange(n, dtype=np.int64)
    held = np.zeros(n_slots, dtype=np.int64)  # xor of the keys that own a slot
    for row in slots:
        np.bitwise_xor.at(held, row, index)
    rounds, left = [], n
    alone = np.flatnonzero(owners == 1)
    while len(alone):
        keys, at = np.unique(held[alone], return_index=True)
        own = alone[at]
        rounds.append((keys, (slots[:, keys] == own).argmax(axis=0)))
        left -= len(keys)
        touched = slots[:, keys]
        for row in touched:
            np.subtract.at(owners, row, 1)
            np.bitwise_xor.at(held, row, keys)
        touched = np.unique(touched)
        alone = touched[owners[touched] == 1]
    return rounds if left == 0 else None


def _solved(keys: np.ndarray) -> tuple[Shape, np.ndarray, list]:
    for seed in range(TRIES):
        shape = shape_for(len(keys), seed)
        slots = slots_of(keys, shape)
        rounds = _peeled(slots, shape.slots)
        if rounds is not None:
            return shape, slots, rounds
    raise ValueError("keys could not be peeled; are there repeated keys?")


class Filter(NamedTuple):
    """Binary-fuse filter with 16-bit fingerprints: no key is missed, 1 in 65,536 others pass."""

    shape: Shape
    table: np.ndarray

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys) or not len(self.table):
            return np.zeros(len(keys), dtype=bool)
        a, b, c = slots_of(keys, self.shape)
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == _fingerprints(keys)


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + np.uint64(0x5851F42D4C957F2D)) & np.uint64(0xFFFF)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> Filter:
    """Filter over distinct 64-bit keys; without keys it holds nothing."""
    if not len(keys):
        return Filter(Shape(0, 4, 1), np.zeros(0, dtype=np.uint16))
    shape, slots, rounds = _solved(keys)
    table = np.zeros(shape.slots, dtype=np.uint16)
    prints = _fingerprints(keys)
    for part, which in reversed(rounds):
        s = slots[:, part]
        rest = table[s[0]] ^ table[s[1]] ^ table[s[2]]  # the own slot is still zero
        table[s[which, np.arange(len(part))]] = prints[part] ^ rest
    return Filter(shape, table)


class PerfectHash(NamedTuple):
    """Minimal perfect hash: n keys to 0 .. n-1, two bits and a rank per slot."""

    shape: Shape
    choice: np.ndarray
    ranks: np.ndarray

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Place of every key; some place for keys that were not among those hashed."""
        s = slots_of(keys, self.shape)
        which = (self.choice[s[0]].astype(np.int64) + self.choice[s[1]] + self.choice[s[2]]) % 3
        return np.minimum(self.ranks[s[which, np.arange(len(keys))]], max(0, int(self.ranks[-1]) - 1))


def build_perfect_hash(keys: np.ndarray) -> PerfectHash:
    """Perfect hash over distinct 64-bit keys, of which there is at least one."""
    shape, slots, rounds = _solved(keys)
    choice = np.zeros(shape.slots, dtype=np.uint8)
    taken = np.zeros(shape.slots, dtype=bool)
    for part, which in reversed(rounds):
        s = slots[:, part]
        own = s[which, np.arange(len(part))]
        rest = (choice[s[0]].astype(np.int64) + choice[s[1]] + choice[s[2]]) % 3
        choice[own] = (which - rest) % 3
        taken[own] = True
    ranks = np.zeros(shape.slots + 1, dtype=np.int64)
    np.cumsum(taken, out=ranks[1:])
    return PerfectHash(shape, choice, ranks)
