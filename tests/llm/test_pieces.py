import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tests.conftest import SF_SMALL
from tillroll.llm import pieces as P
from tillroll.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def digests(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest())


def run(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())],
                                       names=["doc_id", "text"])
    return [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
            for out in P._round_trip(PATH)([batch]) for r in out.to_pylist()]


def test_random_texts_equal_the_library(library):
    rng = random.Random(1)
    signs = [" ", "  ", "▁", "a", "b", "e", "the", "ing", " the", "\n", "\t", "中", "é", "𝒳", "\x00", "=", "--", "<s>",
             "</s>", "<0x41>", " " * 15, " " * 16, "ab" * 20, "=" * 40, "́"]
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choices(pieces, k=rng.randint(1, 60))) for _ in range(1000)]
    texts += ["".join(rng.choices(pieces, k=rng.randint(40, 120))).replace(" ", "") for _ in range(200)]   # long words
    texts += [" " * n + s for n in range(70) for s in ("", "a", "the x")]
    texts += [None, "", " ", "=" * 5000, "ab" * 3000, " " * 5000 + "x", "中文字符" * 1500]
    assert run(texts) == [digests(library, t) for t in texts]


def test_words_open_after_all_rounds_are_finished_by_the_queue(library, monkeypatch):
    monkeypatch.setattr(P, "ROUNDS", 3)
    texts = ["abcdefghij" * 300, "internationalisation " * 40, "==-=" * 100]
    assert run(texts) == [digests(library, t) for t in texts]


def test_small_passes_and_memories_change_nothing(library, monkeypatch):
    monkeypatch.setattr(P, "PASS", 64)
    monkeypatch.setattr(P, "REMEMBERED", 20)
    rng = random.Random(7)
    texts = [" ".join(rng.choices(["one", "two", "drei", "quatre", "中", ""], k=rng.randint(0, 90))) for _ in range(60)]
    assert run(texts) == [digests(library, t) for t in texts]


def test_confirmed_words(library, monkeypatch):
    """Words with one hash are told apart by the second."""
    plain = P._hash_segment
    monkeypatch.setattr(P, "_hash_segment", lambda d, s, e, seed=0: plain(d, s, e, seed))
    known = P._Known()
    known.add(np.array([5], np.uint64), np.array([1], np.uint64), np.array([2]), np.array([7, 8], np.int32))
    assert known.find(np.array([5, 5, 6], np.uint64), np.array([1, 2, 1], np.uint64)).tolist() == [0, -1, -1]


def test_table_round_trip(spark, docs, library):
    rows = [(1, "Ein Satz, äöü."), (None, "x"), (1, "other"), (3, None), (4, "")]
    got = P.round_trip(docs(*rows).withColumnRenamed("lang", "ids_sha256"), PATH).collect()
    assert sorted(tuple(r) for r in got if r[0] is not None) == sorted(
        (d, *digests(library, t)) for d, t in rows if d is not None)
    assert P.round_trip(docs(), PATH).count() == 0
    texts = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    back = {r["doc_id"]: r["text"] for r in P.decode(P.encode(texts, PATH), PATH).collect()}
    assert back == {r["doc_id"]: (r["text"] or "").replace("▁", " ") for r in texts.collect()}
    ids = {r["doc_id"]: r["ids"] for r in P.encode(texts, PATH).collect()}
    assert all(ids[r["doc_id"]] == library.encode(r["text"] or "") for r in texts.collect())
