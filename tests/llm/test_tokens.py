import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillroll.llm import bpe, packing, tokens
from tillroll.llm.queries import vocabulary

WORDS = vocabulary("word_bpe_49k.json")
BYTES = vocabulary("byte_bpe_50k.tiktoken")
TEXTS = ["", None, " ", "Hello  world, it's 'S 's 're''ll\n\n x", "a<|endoftext|>b <|startoftext|>", "İstanbul ǅ ﬁ Ǻ é",
         "tabs\t\tand no-break space\x85\x1c.", "日本語テキスト 😀😀 naïve", "x" * 3000, "don't can't we'll I'M 12 345 ½ Ⅷ",
         " leading", "trailing ", "\n\n\nfoo \n bar\r\n", "…  !?  ''s", "'s't", "a 's", "́combining first", "ab\x00cd"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def tik():
    import public_tokenizers
    import tiktoken
    with open(BYTES, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz(seed, n=150):
    rng = random.Random(seed)
    alphabet = list("aabcdest  \n\t'.,!?-_/0123IiKſ") + ["'s", "'ll", " the", "é", "ß", "日", "😀", " ", " ", "́", "<|endoftext|>"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(n)]


def test_counts_equal_the_library(docs, plain, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 2000)
    texts = TEXTS + fuzz(1) + [" ".join(fuzz(2))]
    got = tokens.token_counts(docs(*enumerate(texts)).withColumn("n_tokens", F.lit(0)), WORDS, limit=20).collect()
    for r in got:
        t = texts[r.doc_id] or ""
        n = len(plain.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 20), t
    assert tokens.token_counts(docs(), WORDS).count() == 0


def test_memory_of_words_is_bounded(plain, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    coder = tokens.WordEncoder(WORDS)
    text = "one two three four five six one two " * 3
    for _ in range(3):
        for _, counts, values, which in _segments(coder, text):
            ids = np.frombuffer(b"".join(values[w] for w in which), "<u4").tolist()
            assert ids == plain.encode(text, add_special_tokens=False).ids
        assert len(coder.recent) <= 6


def _segments(coder, text):
    tokens.WordEncoder._loaded["test"] = coder
    return tokens.encoded_segments(pa.array([text]), "test")


def test_round_trip_equals_the_library(docs, tik):
    texts = TEXTS + fuzz(3) + ["z" * 500 + " " * 70 + "word" * 60]
    df = docs(*enumerate(texts), (None, "x"), (0, "")).withColumn("ids", F.lit(1))
    for size in (64, 100_000):
        for r in bpe.round_trip(df, BYTES, size).collect():
            t = "x" if r.doc_id is None else texts[r.doc_id] or ""
            ids = tik.encode_ordinary(t)
            assert r.n_tokens == len(ids), t
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), t
            assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest(), t
    assert bpe.round_trip(docs(), BYTES).count() == 0


def test_fold_equals_in_place_merges(spark):
    ranks, _ = bpe.load_ranks(BYTES)
    rng = random.Random(8)
    words = {bytes(rng.choices(b" abcdehilnorst\xc3\xa9", k=rng.randint(1, 30))) for _ in range(300)}
    df = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")
    got = {bytes(r.word): list(r.ids) for r in bpe.fold_merges(df, ranks).collect()}
    assert got == {w: bpe.merge_word(w, ranks) for w in words}


def test_long_words_merge_as_short_ones():
    ranks, _ = bpe.load_ranks(BYTES)
    for word in (b"thequickbrownfox" * 4, b"a" * 300, bytes(range(256))):
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            found = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            if not found or min(found) == 1 << 60:
                break
            i = found.index(min(found))
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merge_word(word, ranks) == [ranks[p] for p in parts]


def check_packing(rows, texts, plain, capacity):
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        want = [(p, a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes()))
                for p, a in enumerate(range(0, len(ids), capacity))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[i]) == want
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(bins), -(-total // capacity)


def test_packing_is_whole_gapless_and_tight(docs, plain, monkeypatch):
    rng = random.Random(6)
    texts = [None, "", "word " * 700] + ["tok " * rng.randint(0, 120) for _ in range(400)]
    for block in (4096, 60):
        monkeypatch.setattr(packing, "BLOCK_ITEMS", block)
        rows = packing.packed_pieces(docs(*enumerate(texts)).withColumn("uid", F.lit(1)), WORDS, 128).collect()
        bins, bound = check_packing(rows, texts, plain, 128)
        plain_fit: list[int] = []
        packing.best_fit([r.length for r in rows], sorted(range(len(rows)), key=lambda i: -rows[i].length),
                         plain_fit, 128, np.zeros(len(rows), np.int64))
        assert bound <= bins <= len(plain_fit) * (1 if block == 4096 else 1.05)
    assert packing.packed_pieces(docs(), WORDS, 128).count() == 0
    repeated = packing.packed_pieces(docs((1, "a b"), (1, "a b"), (None, "c")), WORDS, 128).collect()
    assert len(repeated) == 3 and len({r.offset for r in repeated}) == 3


def test_genetic_steps_keep_solutions_valid_and_help():
    rng = np.random.default_rng(2)
    lengths = rng.integers(20, 60, 300)
    best = packing.evolve(lengths, [], 100, 1)
    first = np.zeros(300, np.int64)
    packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), [], 100, first)
    assert np.bincount(best, lengths).max() <= 100
    assert packing._score(lengths, best, 100) <= packing._score(lengths, first, 100)
    other = packing.evolve(lengths, [best], 100, 9)
    assert packing._score(lengths, other, 100) <= packing._score(lengths, best, 100)
    child = packing.cross(lengths, best, first.astype(np.int32), 100, rng)
    assert np.bincount(child, lengths).max() <= 100 and len(child) == 300
