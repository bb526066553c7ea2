"""Words that a polynomial hash modulo 2**64 takes as equal, through every operator that remembers or compares words."""

import zlib

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from tests.llm.test_textkit import thue_morse
from tillroll.llm import bpe, jaccard, packing, substrings, tokens
from tillroll.llm.queries import vocabulary

ONE, TWO = thue_morse(1024), thue_morse(1024, True)


def test_byte_bpe_ids_differ(spark, docs):
    import public_tokenizers

    path = vocabulary("byte_bpe_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path)[0],
                              special_tokens={})
    got = {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip(docs((1, ONE), (2, TWO)).coalesce(1), path).collect()}
    assert got == {1: len(coder.encode_ordinary(ONE)), 2: len(coder.encode_ordinary(TWO))}
    rows = bpe.round_trip(docs((1, ONE), (2, TWO)).coalesce(1), path).collect()
    assert len({r["decoded_sha256"] for r in rows}) == 2


def test_texts_without_a_common_word_do_not_link(spark, docs):
    got = jaccard.near_duplicates(docs((1, ONE), (2, TWO)).coalesce(1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2}


def test_passages_are_told_apart(spark, docs):
    body = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{body} {ONE}"), (2, f"{body} {TWO}"), (3, f"{body} {TWO}")]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.removal_digest(docs(*rows).coalesce(1)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_counts_and_packed_ids_are_the_tokenizers(spark, docs):
    path = vocabulary("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    table = docs((1, ONE), (2, TWO)).coalesce(1)
    ids = {d: coder.encode(t, add_special_tokens=False).ids for d, t in ((1, ONE), (2, TWO))}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(table, path).collect()} == {
        d: len(x) for d, x in ids.items()}
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.packed_pieces(table, path, 4096, end_id=1).collect()}
    assert got == {d: zlib.crc32(np.array([*x, 1], "<u4").tobytes()) for d, x in ids.items()}
