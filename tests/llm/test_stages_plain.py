"""Stages of the pipeline (all but packing) against plain Python on the small table."""
import itertools
import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF_SMALL
from tillroll.llm import quality, secrets
from tillroll.llm.shared import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_kept_rows_and_texts_of_quality_and_near_duplicates(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in quality.verdicts(docs).collect() if r.kept}
    got = corpus_pipeline.quality_rules(spark, docs, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(rows[i]) for i in good)

    sets = {i: shingles(r.text) for i, r in rows.items()}
    root = {i: i for i in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(sorted(rows), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    want = [tuple(r) for i, r in rows.items() if top(i) == i]
    assert len(want) < len(rows)
    got = corpus_pipeline.near_duplicates(spark, docs, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_kept_words_of_substring_dedup(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = sorted((r.doc_id, WORD.findall(r.text or "")) for r in docs.collect())
    seen, want = set(), {}
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 19):
            window = tuple(w[k:k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        want[i] = [x for k, x in enumerate(w) if k not in gone]
    assert any(len(want[i]) < len(w) for i, w in rows)
    got = corpus_pipeline.repeated_passages(spark, docs, SF_SMALL).collect()
    assert {r.doc_id: WORD.findall(r.text or "") for r in got} == want and len(got) == len(rows)


def test_texts_of_secret_masking(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("text IS NOT NULL")
    key = F.concat("text", F.lit(' token = "'), F.sha1("text"), F.lit('" end'))
    docs = stored(docs.withColumn("text", F.when(F.expr("doc_id % 10 = 0"), key).otherwise(F.col("text"))), "test-keys")
    field = secrets.learn(docs.select("doc_id", "text"))
    want = {}
    for r in docs.collect():
        chain = secrets.Tokens(r.text, field.pairs)
        tags = field.decode(chain.run(0, len(chain.words))) if field.weights and chain.words else []
        covered = {k for a, b, _ in secrets.base_spans(r.text) for k in range(a, b)}
        base = secrets.base_spans(r.text)
        found = []
        for (a, b), tag in zip(chain.spans, tags):
            if tag == secrets.BEGIN:
                found.append([a, b])
            elif tag == secrets.INSIDE:
                found[-1][1] = b
        covered |= {k for a, b in found if not any(s <= a and b <= e for s, e, _ in base) for k in range(a, b)}
        want[r.doc_id] = "".join(c for k, c in enumerate(r.text) if k not in covered)
    got = corpus_pipeline.secret_masking(spark, docs, SF_SMALL).collect()
    assert {r.doc_id: r.text.replace("[secret]", "") for r in got} == want
    assert any("[secret]" in r.text for r in got) and all(r.n_chars == len(r.text) for r in got)
