"""Vectorised word handling shared by the text operators.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  Words become
64-bit hashes with whole-array NumPy operations over the UTF-8 buffer of an
Arrow batch, so a pass over the corpus costs nanoseconds a byte and needs no
Python object per word.  Work arrays are bounded: texts are taken in segments
of at most ``SEGMENT`` bytes, cut between words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SEGMENT = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_SLOT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
#: Keeps the first k of the eight bytes of a little-endian integer, by k.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
#: Seed of the hash that confirms a word found by its first hash.
CHECK = 0x51ED270B


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word; no word crosses a cut."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[cuts] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    before |= edge[:n]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    after |= edge[1:]
    return np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1


def _hash_segment(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each word: its bytes, eight at a time, go through the mixer (so words of
    up to eight bytes of one length can't collide); long words through xxh3.
    Another ``seed`` gives a second hash that tells apart what the first confuses."""
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))       # the eight bytes from each place
    state = mix(size.astype(np.uint64) * _SLOT[0] + _U(seed))
    state = mix(state ^ (eight[starts] & _FIRST[np.minimum(size, 8)]))
    rest, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(rest):
        left = size[rest] - done
        state[rest] = mix(state[rest] * _SLOT[1] ^ (eight[starts[rest] + done] & _FIRST[np.minimum(left, 8)]))
        rest, done = rest[left > 8], done + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        state[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]].tobytes(), seed)
    return state


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Hashes of the distinct words, the first place of each, and for each word which
    of them it is."""
    return np.unique(_hash_segment(data, starts, ends), return_index=True, return_inverse=True)


def segments(offsets: np.ndarray, limit: int = SEGMENT):
    """Runs (first, last) of texts of at most ``limit`` bytes together; a longer
    text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _cut_long(data: np.ndarray) -> list[int]:
    """Places in one long text, before a space, that leave pieces of about
    ``SEGMENT`` bytes (longer only where a word is)."""
    cuts, at, n = [0], 0, len(data)
    while n - at > SEGMENT:
        stop = at + SEGMENT
        tail = np.flatnonzero(SPACE[data[at + 1:stop]])
        if len(tail):
            at = at + 1 + int(tail[-1])
        else:
            gap = np.flatnonzero(SPACE[data[stop:]])
            if not len(gap):
                break
            at = stop + int(gap[0])
        cuts.append(at)
    return [*cuts, n]


def word_hashes(column: pa.Array, lower: bool = False):
    """Yield (first row, word hashes, word counts of the rows) by runs of rows."""
    data, offsets = text_buffer(column)
    for first, last in segments(offsets):
        lo, hi = int(offsets[first]), int(offsets[last])
        part = data[lo:hi]
        if lower:
            part = LOWER[part]
        if last - first == 1 and hi - lo > SEGMENT:
            cuts, hashes = _cut_long(part), []
            for a, b in zip(cuts[:-1], cuts[1:]):
                s, e = word_bounds(part[a:b], np.array([0]))
                hashes.append(_hash_segment(part[a:b], s, e))
            words = np.concatenate(hashes)
            yield first, words, np.array([len(words)])
            continue
        cuts = offsets[first:last + 1] - lo
        starts, ends = word_bounds(part, cuts)
        counts = np.diff(np.searchsorted(starts, cuts))
        yield first, _hash_segment(part, starts, ends), counts


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if len(_SLOT) < size:
        raise ValueError(f"runs of more than {len(_SLOT)} words are not supported")
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out += words[j:j + n] * _SLOT[j]
    return mix(out)
