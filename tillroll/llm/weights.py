"""Weights of named features in arrays: no Python object for a feature.

A feature is found by a hash of its name; a second hash tells apart what the first
confuses.  A name that says what a neighbour is (``before1=word``) has the hash of
the neighbour, changed by where it stands, so that what a word gains at all four
places is found at once.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tillroll.llm.textkit import CHECK, _hash_segment, text_buffer

#: How names of features that a neighbour has begin, and what changes its hash there (nothing for all others).
PLACES = ("before1=", "before2=", "before3=", "after=")
_SALT = np.concatenate(([0], np.random.default_rng(20250611).integers(1, 2**63, len(PLACES), dtype=np.uint64))).astype(np.uint64)
#: Numbers that vectors on disk are worked on at once.
CHUNK = 1 << 16


def hashes(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every name."""
    data, offsets = text_buffer(names)
    return _hash_segment(data, offsets[:-1], offsets[1:]), _hash_segment(data, offsets[:-1], offsets[1:], CHECK)


def feature_keys(names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key and check of every feature, and the number of its place (0 if it has none)."""
    data, offsets = text_buffer(names)
    start, end, place = offsets[:-1].copy(), offsets[1:], np.zeros(len(names), np.uint8)
    for i, lead in enumerate(PLACES, 1):
        own = pc.starts_with(names, lead).to_numpy(zero_copy_only=False)
        place[own] = i
        start[own] += len(lead)
    return _hash_segment(data, start, end) ^ _SALT[place], _hash_segment(data, start, end, CHECK), place


class Features:
    """Distinct features, numbered in the order of their keys and checks."""

    def __init__(self, keys: np.ndarray, checks: np.ndarray, place: np.ndarray | None = None):
        order = np.lexsort((checks, keys))
        self.keys, self.checks = keys[order], checks[order]
        self.place = np.zeros(len(keys), np.uint8) if place is None else place[order]
        first = np.flatnonzero(np.concatenate(([True], self.keys[1:] != self.keys[:-1])))
        self.alike = int(np.diff(np.append(first, len(keys))).max()) if len(keys) else 0

    def __len__(self) -> int:
        return len(self.keys)

    def __contains__(self, name: str) -> bool:
        return bool(self.find(pa.array([name], pa.string()))[0] < len(self))

    def find(self, names: pa.Array) -> np.ndarray:
        """The number of every feature; ``len`` where there is none."""
        return self.at(*feature_keys(names)[:2])

    def at(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        n = len(self)
        found, first = np.full(len(keys), n), np.searchsorted(self.keys, keys)
        for i in range(self.alike):
            k = np.minimum(first + i, n - 1)
            hit = (self.keys[k] == keys) & (self.checks[k] == checks)
            found[hit] = k[hit]
        return found


class Weights:
    """Weights (a row of ``table`` each; the last one, of zeros, for all others) of features."""

    def __init__(self, features: Features, table: np.ndarray):
        self.features, self.table = features, table

    @classmethod
    def named(cls, weights: dict[str, np.ndarray]) -> Weights:
        keys, checks, place = feature_keys(pa.array(list(weights), pa.string()))
        features, table = Features(keys, checks, place), np.zeros((len(weights) + 1, 3))
        table[features.at(keys, checks)] = np.array(list(weights.values()), float).reshape(-1, 3)
        return cls(features, table)

    def __len__(self) -> int:
        return len(self.features)

    def __contains__(self, name: str) -> bool:
        return name in self.features

    def rows(self, names: list[str]) -> np.ndarray:
        return self.features.find(pa.array(names, pa.string()))

    def neighbours(self) -> tuple[Features, np.ndarray]:
        """What is known as a neighbour, by the hashes of its name, and what it gains over
        outside (begin and inside) at each place; the last row is of zeros."""
        f = self.features
        near = np.flatnonzero(f.place)
        place = f.place[near].astype(np.int64)
        keys, checks = f.keys[near] ^ _SALT[place], f.checks[near]
        order = np.lexsort((checks, keys))
        new = np.concatenate(([True], (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])))[:len(near)]
        own = np.empty(len(near), np.int64)
        own[order] = np.cumsum(new) - 1
        gains = np.zeros((int(new.sum()) + 1, 2 * len(PLACES)))
        for c in (0, 1):
            gains[own, 2 * (place - 1) + c] = self.table[near, 1 + c] - self.table[near, 0]
        return Features(keys[order][new], checks[order][new]), gains


def on_disk(n: int) -> np.ndarray:
    """A vector of zeros in a file without a name, gone with the vector: what the driver holds
    of it in memory is up to the system."""
    with tempfile.TemporaryFile() as file:
        os.posix_fallocate(file.fileno(), 0, 8 * n)
        return np.frombuffer(mmap.mmap(file.fileno(), 8 * n), np.float64)


def fill(to: np.ndarray, make) -> None:
    """Sets ``to`` part by part: ``make`` gives the numbers of a slice."""
    for first in range(0, len(to), CHUNK):
        part = slice(first, first + CHUNK)
        to[part] = make(part)
