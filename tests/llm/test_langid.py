import zlib

import numpy as np
from pyspark.sql import functions as F

from tillroll.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    right = [truth[r.doc_id] == r.lang_pred for r in got if r.held_out]
    assert np.mean(right) >= 0.97


def test_only_texts_decide_and_edge_cases(docs):
    en, de, fr, es = ("the house and the garden of this town were there ", "der und die haus garten nicht ist das ",
                      "le la les maison jardin est dans cette ville ", "el la los casa jardín es en esta ciudad ")
    rows = [(i, t * 3 + f"n{i}", lang) for i in range(40) for t, lang in
            (((en, "en"), (de, "de"), (fr, "fr"), (es, "es"))[i % 4],)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !!", "de"), (103, de, None), (None, fr, None),
             (104, en * 20_000, "en"), (105, "ñ", "es"), (105, "ñ", "es")]
    got = {(r.doc_id, k): r for k, r in enumerate(langid.identify(docs(*rows).withColumn("score", F.lit(1))).collect())}
    by = {i: r for (i, _), r in got.items()}
    assert len(got) == len(rows)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102))
    assert by[103].lang_pred == "de" and by[None].lang_pred == "fr" and not by[None].held_out
    assert sum(by[i].lang_pred == rows[i][2] for i in range(40)) >= 38
    assert langid.identify(docs()).count() == 0
    assert {r.lang_pred for r in langid.identify(docs((1, "some words", None))).collect()} == {"und"}


def test_held_out_rows_teach_nothing(docs):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    rest = [i for i in range(60) if i not in held]
    rows = [(i, "alpha beta gamma", "aa") for i in rest] + [(i, "delta epsilon", "bb") for i in held]
    assert {r.lang_pred for r in langid.identify(docs(*rows)).collect()} == {"aa"}


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(1, 0.3, (50, 4)), rng.normal(-1, 0.3, (50, 4))))
    y = np.repeat([1, -1], 50)
    assert ((x @ langid.train_svm(x, y) > 0) == (y > 0)).all()
