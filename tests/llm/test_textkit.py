import random
import re

import numpy as np
import pyarrow as pa

from tillroll.llm import exchange as X
from tillroll.llm import textkit as T

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_words_match_the_pattern_and_hash_alike():
    rng = random.Random(3)
    alphabet = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "a", "B", "é", "中", "\x1f", "\xa0", "."]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(300)] + ["", None, "   "]
    seen = {}
    rows = [None] * len(texts)
    for first, hashes, counts in T.word_hashes(pa.array(texts)):
        at = 0
        for k, n in enumerate(counts.tolist()):
            rows[first + k] = hashes[at:at + n].tolist()
            at += n
    for text, found in zip(texts, rows):
        words = WORD.findall((text or "").encode())
        assert len(words) == len(found)
        for w, h in zip(words, found):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", 64)
    text = " ".join(f"w{i}" for i in range(200)) + " " + "x" * 300 + " end"
    (first, hashes, counts), = T.word_hashes(pa.array([text]))
    assert counts.tolist() == [202] and len(hashes) == 202
    whole = {w: h for w, h in zip(text.split(), hashes.tolist())}
    _, one, _ = next(T.word_hashes(pa.array(["end"])))
    assert whole["end"] == one[0]


def test_cells_round_trip():
    v = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (X.unpack_sorted(X.pack_sorted(v)) == v).all()
    ids = np.array([5, -3, 2**62, -2**63, 2**63 - 1, 0])
    assert (X.unpack_ids(X.pack_ids(ids)) == ids).all()
    assert len(X.unpack_ints(X.pack_ints(np.zeros(0, np.uint64)))) == 0
    assert X.part_of(v, 7).max() <= 6 and (np.diff(X.part_of(v, 7).astype(int)) >= 0).all()


def thue_morse(n, swap=False):
    """A word whose polynomial hash modulo 2**64 equals that of its mirror, from 1,024 letters on."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_hashes_tell_apart_words_made_to_collide():
    for n in (16, 128, 256, 257, 512, 1024, 4096):
        for seed in (0, T.CHECK):
            data = np.frombuffer((thue_morse(n) + thue_morse(n, True)).encode(), np.uint8)
            one, two = T._hash_segment(data, np.array([0, n]), np.array([n, 2 * n]), seed)
            assert one != two
    data = np.frombuffer(b"ab\x00ab\x00\x00", np.uint8)
    assert len(set(T._hash_segment(data, np.array([0, 0, 3]), np.array([2, 3, 7])).tolist())) == 3
