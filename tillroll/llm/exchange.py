"""Exchange of hash keys in packed cells.

Shuffling one row per n-gram costs far more than the eight bytes of its hash.
A task therefore sorts the keys it has seen (combining equal ones, so that a
hot key leaves a task once), deals them out by key and sends one packed cell
per target partition.  Spark moves the cells; the target merges them with
sorted arrays.  A cell is delta coded and its bytes are stored by planes, which
the shuffle's own compression then shortens.
"""

from __future__ import annotations

import numpy as np

_HEAD = 8


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned integers as little-endian byte planes, highest zero planes left out."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    top = int(values.max()) if len(values) else 0
    planes = max(1, (top.bit_length() + 7) // 8)
    raw = values.view(np.uint8).reshape(-1, 8)[:, :planes]
    return len(values).to_bytes(7, "little") + bytes([planes]) + np.ascontiguousarray(raw.T).tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    n, planes = int.from_bytes(data[:7], "little"), data[7]
    raw = np.zeros((n, 8), dtype=np.uint8)
    if n:
        raw[:, :planes] = np.frombuffer(data, np.uint8, n * planes, _HEAD).reshape(planes, n).T
    return raw.reshape(-1).view(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    """As :func:`pack_ints`, of the steps between ascending values."""
    values = np.asarray(values, dtype=np.uint64)
    return pack_ints(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data), dtype=np.uint64)


def zigzag(values: np.ndarray) -> np.ndarray:
    """Signed integers as unsigned ones, small magnitudes small."""
    v = np.asarray(values, dtype=np.int64)
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def unzigzag(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)


def pack_ids(ids: np.ndarray) -> bytes:
    """Signed 64-bit ids in any order (steps between neighbours)."""
    return pack_ints(zigzag(np.diff(np.asarray(ids, np.int64), prepend=np.int64(0))))


def unpack_ids(data: bytes) -> np.ndarray:
    return np.cumsum(unzigzag(unpack_ints(data)))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Partition of each key: by its upper 32 bits, so that sorted keys stay
    together and each partition holds one range."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
