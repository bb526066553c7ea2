import collections
import re

from pyspark.sql import functions as F

from tillroll.llm import quality
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 20 or 100 * n[4] > 30 * n[0])


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_measures_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.verdicts(docs).collect():
        assert tuple(r[c] for c in COLUMNS) == base(text[r.doc_id])
        assert not (r.base_failed and r.kept) and 0 <= r.quality <= 1


def test_separates_the_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = (quality.verdicts(docs).join(spark.read.parquet(f"{sf}/labels.parquet")
                                         .select("doc_id", F.col("quality").alias("label")), "doc_id"))
    n = {(r.label, r.kept): r["count"] for r in found.where("NOT base_failed").groupBy("label", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)]
    assert n.get((0, True), 0) <= 0.05 * n[(0, False)]


def test_edge_cases(docs):
    stutter = " ".join(f"w{i // 9}" for i in range(90))
    rows = [(1, None), (2, ""), (3, " \n\n\t"), (4, "a b c d e f g h a b c d e f g h"), (5, "x" * 50_000),
            (6, "é ü\x0bñ\x0cz\n\nline\nline\nline"), (6, "é ü\x0bñ\x0cz\n\nline\nline\nline"), (None, stutter),
            (7, "the same eight words are in this line here\n" * 40)]
    got = quality.verdicts(docs(*rows).withColumn("_w", F.lit(1)).withColumn("votes", F.lit(2))).collect()
    assert sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in got) == sorted(
        (str(i), *base(t)) for i, t in rows)
    assert quality.verdicts(docs()).count() == 0
    kept = quality.keep_good(docs(*rows).withColumn("kept", F.lit("mine")))
    assert kept.columns[-1] == "kept" and kept.columns[:2] == ["doc_id", "text"]


def test_estimated_rates_agree_with_a_plain_version(spark):
    """The fold equals the same steps in Python."""
    import math
    rows = [([1, -1, 0], 5.0), ([1, 1, 1], 40.0), ([-1, -1, 0], 9.0), ([-1, 1, -1], 2.0)]
    voted = spark.createDataFrame([(v,) for v, c in rows for _ in range(int(c))], "votes array<int>")
    m = {"p": quality.PRIOR_GOOD, **{k: [x] * 3 for k, x in quality.PRIOR_RATES.items()}}
    for _ in range(quality.STEPS):
        post = []
        for v, c in rows:
            s = math.log(m["p"] / (1 - m["p"]))
            for j, x in enumerate(v):
                if x > 0:
                    s += max(0, math.log(m["gp"][j] / m["bp"][j]))
                if x < 0:
                    s += min(0, math.log(m["gn"][j] / m["bn"][j]))
            post.append((v, c / (1 + math.exp(-s)), c - c / (1 + math.exp(-s))))
        good, bad = sum(g for _, g, _ in post), sum(b for _, _, b in post)

        def rate(side, sign, name):
            total = (good, bad)[side]
            return [max(quality.LEAST_RATE, (sum(p[1 + side] for p in post if p[0][j] == sign)
                                             + quality.PRIOR_RATES[name] * quality.PRIOR_DOCS)
                        / (total + quality.PRIOR_DOCS)) for j in range(3)]
        m = {"p": min(0.9999, max(0.0001, (good + quality.PRIOR_GOOD) / (good + bad + 1))),
             "gp": rate(0, 1, "gp"), "gn": rate(0, -1, "gn"), "bp": rate(1, 1, "bp"), "bn": rate(1, -1, "bn")}
    got = quality.estimate(voted, 3).first()["model"]
    assert abs(got["p"] - m["p"]) < 1e-9
    for k in quality.PRIOR_RATES:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[k], m[k]))


def test_main_path_has_no_python(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan = quality.measures(docs, ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_second_key_of_a_text_does_not_follow_from_the_first(docs, monkeypatch):
    """Spark goes on from the hash of one column as the seed of the next."""
    keys, score = [], quality.score
    monkeypatch.setattr(quality, "score", lambda d, names: (keys.extend([d, names]), score(d, names))[1])
    quality.keep_good(docs((1, "one"), (2, "two words")))
    table, (first, second) = keys
    follows = F.expr(f"reflect('org.apache.spark.sql.catalyst.expressions.XXH64', 'hashInt', 1, {first})")
    assert table.where(follows.cast("long") == F.col(second)).count() == 0
