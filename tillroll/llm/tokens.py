"""Token counts and ids with a tokenizer that joins neither across white space
nor a letter and a sentence sign.

Texts are taken in segments balanced by bytes; a long text is cut before a
space, where this kind of tokenizer (white space dropped) starts anew.  A sign
such as a comma that ends a word after a plain letter is a word of its own.
Within a segment only distinct words that the task hasn't met lately are
encoded, many in one call; the rest is array lookups.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.shared import tune
from tillroll.llm.textkit import (CHECK, SEGMENT, _cut_long, _hash_segment, distinct_words, segments,
                                  text_buffer, word_bounds)

#: Words remembered by a worker (in each of two generations), and encoded in one call.
REMEMBERED, AT_ONCE = 350_000, 512


_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in ",.;:!?"]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(65, 91), *range(97, 123)]] = True


def token_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each piece that can be encoded by itself."""
    starts, ends = word_bounds(data, cuts)
    apart = ends[(ends - starts > 1) & _SIGN[data[ends - 1]] & _PLAIN[data[ends - 2]]] - 1
    if len(apart):
        starts, ends = np.sort(np.concatenate((starts, apart))), np.sort(np.concatenate((ends, apart)))
    return starts, ends


class WordEncoder:
    """Ids of words by a tokenizers file; a bounded memory of recent words."""

    _loaded: dict[str, "WordEncoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.recent: dict[int, tuple[int, bytes]] = {}
        self.older: dict[int, tuple[int, bytes]] = {}

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word (encoded side by side, told apart
        by the tokens' offsets)."""
        out: list[bytes] = []
        for i in range(0, len(words), AT_ONCE):
            some = words[i:i + AT_ONCE]
            found = self.tokenizer.encode("\n".join(some), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in some])
            at = np.array([a for a, _ in found.offsets], np.int64)
            ids = np.array(found.ids, dtype="<u4")
            cuts = np.searchsorted(at, starts)
            out += [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return out

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Ids of the distinct words and, for each word, which of them it is.  A word is
        remembered by its hash, with a second hash that confirms it."""
        keys, first, which = distinct_words(data, starts, ends)
        known, old = self.recent, self.older
        checks = _hash_segment(data, starts[first], ends[first], CHECK).tolist()
        names = keys.tolist()
        values = [v[1] if v is not None and v[0] == check else None for v, check in zip(map(known.get, names), checks)]
        missing = []
        for i in [i for i, v in enumerate(values) if v is None]:
            k = names[i]
            v = known.get(k)
            if v is None:
                v = old.get(k)
                if v is not None:
                    known[k] = v
            if v is None or v[0] != checks[i]:
                missing.append(i)
            else:
                values[i] = v[1]
        if missing:
            raw, at = data.tobytes(), first[missing]
            fresh = self.encode([raw[a:b].decode("utf-8", "replace")
                                 for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            for i, k, v in zip(missing, keys[missing].tolist(), fresh):
                values[i] = v
                known[k] = checks[i], v
        if len(known) > REMEMBERED:
            self.older, self.recent = known, {}
        return values, which


def encoded_segments(column: pa.Array, path: str):
    """Yield (first row, word counts of the rows, ids of distinct words, which of
    them each word is); a long text comes in several yields of one row."""
    coder = WordEncoder.of(path)
    data, offsets = text_buffer(column)
    for first, last in segments(offsets):
        lo, hi = int(offsets[first]), int(offsets[last])
        part = data[lo:hi]
        if last - first == 1 and hi - lo > SEGMENT:
            cuts = _cut_long(part)
            for a, b in zip(cuts[:-1], cuts[1:]):
                s, e = token_words(part[a:b], np.array([0]))
                values, which = coder.lookup(part[a:b], s, e)
                yield first, np.array([len(s)]), values, which
            continue
        bounds = offsets[first:last + 1] - lo
        s, e = token_words(part, bounds)
        values, which = coder.lookup(part, s, e)
        yield first, np.diff(np.searchsorted(s, bounds)), values, which


def _counts(path: str, limit: int):
    def run(batches):
        for batch in batches:
            column = batch.column("text")
            _, offsets = text_buffer(column)
            total = np.zeros(len(column), np.int64)
            for first, counts, values, which in encoded_segments(column, path):
                lengths = np.array([len(v) // 4 for v in values], np.int64)
                sums = np.concatenate(([0], np.cumsum(lengths[which]) if len(which) else []))
                ends = np.cumsum(counts)
                total[first:first + len(counts)] += (sums[ends] - sums[ends - counts]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(total),
                 pa.array(total > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id,
    text; other columns ignored).  ``path``: a tokenizers file, on every machine.
    Null text is empty (no bytes, no tokens); doc_id may be null or repeat."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_counts(path, limit),
                           "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
