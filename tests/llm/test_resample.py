import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF_SMALL
from tillroll.llm import resample as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % 10000
                        for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def expected(docs, target, percent=5, least=20):
    own = [(d, *windows(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in windows(x)[1])
    ss, tt = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ss + 10000) / ((s[b] + 1.0) * (tt + 10000))))
    rows = {}
    for d, n, f in own:
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        score = None if d is None else w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.setdefault(d, []).append([d, len(f), w, score, None, n])
    able = sorted((r for x in rows.values() for r in x if r[0] is not None and r[5] >= least),
                  key=lambda r: (-r[3], r[0], -r[1], -r[2]))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for x in rows.values() for r in x), key=repr)


def test_window_checksums_equal_zlib():
    rng = random.Random(2)
    letters = ["a", "B", "é", "中", " ", "  ", "-", "\n", "0", "word", "x" * 70, "ÄÖ", "İ", "\x00", "\x7f", "\x80"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(500)]
    texts += [None, "", "a", "a b", "y" * 5000 + " b " + "é" * 400]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())],
                                       names=["doc_id", "text"])
    for row, text in zip(next(R._features(10000)([batch])).to_pylist(), texts):
        n, found = windows(text)
        assert row["n_words"] == n
        assert sorted(np.frombuffer(row["buckets"], "<u2").tolist()) == sorted(found)


def test_long_texts_are_cut_behind_words(monkeypatch):
    monkeypatch.setattr(R, "SEGMENT", 50)
    text = " ".join(f"wort{i} é" for i in range(200)) + " " + "z" * 300 + " end"
    data = np.frombuffer(text.encode(), np.uint8)
    places = R.word_offsets(data, 0, len(data))
    assert [text.encode()[a:b].decode() for a, b in zip(places[::2], places[1::2])] == WORD.findall(text)


def test_draw_equals_plain_python(spark, docs):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "x1"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(150)]
    rows += [(None, rows[3][1]), (7, rows[3][1]), (200, None), (201, ""), (202, "a"), (7, rows[7][1])]
    target = [(i, " ".join(rng.choices(vocabulary[:10], k=30))) for i in range(20)] + [(None, None)]
    got = R.resample(docs(*rows).withColumnRenamed("n_chars", "score"), docs(*target)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows, [t for _, t in target])
    assert sum(r["rank"] is not None for r in got) == 5 * sum(windows(t)[0] >= 20 and d is not None for d, t in rows) // 100


def test_empty_tables_and_bounds(spark, docs):
    some = docs((1, "a b c"), (2, None))
    assert R.resample(docs(), some).count() == 0
    got = {r["doc_id"]: r for r in R.resample(some, docs()).collect()}
    assert got[1]["n_features"] == 6 and got[2]["weight"] == 0 and got[1]["rank"] is None
    with pytest.raises(ValueError):
        R.resample(some, some, buckets=1 << 17)


def test_drawn_rows_lean_towards_the_target(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    target = docs.where("lang = 'de'")
    got = R.drawn(docs, target, percent=10)
    assert got.columns == docs.columns and got.where("lang <> 'de'").count() == 0 < got.count()
