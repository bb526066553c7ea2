import random
import re

from pyspark.sql import functions as F

from tillroll.llm import components as C
from tillroll.llm import jaccard, shared


def shingles(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if either and both and den * both >= num * either:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(df, k, num, den):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, k, num, den).collect()}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(words) for _ in range(40)]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 30, 90]))]
        if g % 3 == 0:
            base += passage
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy) if rng.random() < 0.8 else " ".join(base).upper())
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_equals_brute_force(docs):
    for seed, (k, num, den) in ((1, (4, 85, 100)), (2, (5, 80, 100))):
        rows = corpus(seed) + [(900, ""), (901, None), (902, " \n"), (903, "one two"), (904, "ONE  two")]
        assert found(docs(*rows), k, num, den) == brute(rows, k, num, den)


def test_large_group_of_near_copies(docs):
    rng = random.Random(5)
    base = [f"v{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    assert found(docs(*rows), 4, 85, 100) == brute(rows, 4, 85, 100)


def test_chain_links_only_by_neighbours(docs):
    words = [f"c{i}" for i in range(140)]
    rows = [(i, " ".join(words[2 * i:2 * i + 60])) for i in range(30)]
    assert found(docs(*rows), 4, 85, 100) == brute(rows, 4, 85, 100)


def test_nulls_repeats_and_empty(docs, spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "z y x w v"), (None, None), (7, "A b C d E")]
    got = sorted(map(tuple, jaccard.near_duplicates(docs(*rows), 4, 85, 100).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 2, None), (None, 0, None), (7, 2, 5)], key=str)
    assert jaccard.near_duplicates(docs().withColumn("cls", F.lit(1)), 4, 85, 100).count() == 0
    kept = jaccard.keep_first(docs(*rows).withColumn("component_id", F.lit(1)), 4, 85, 100)
    assert kept.columns[-1] == "component_id" and {r.doc_id for r in kept.collect()} == {5, None}


def test_rows_that_share_a_doc_id_stay_or_go_by_their_own_text(docs):
    copied, clean = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(2, copied), (9, copied), (9, clean), (12, clean), (20, "x y z"), (20, clean), (None, clean), (30, None)]
    kept = jaccard.keep_first(docs(*rows).withColumn("cls", F.lit("mine")), 5, 80, 100)
    assert kept.columns[-1] == "cls"
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(2, copied), (9, clean), (20, "x y z"), (None, clean), (30, None)], key=str)


def test_one_text_of_a_doc_id_stays_in_a_component(docs):
    near = [f"a{i}" for i in range(60)]
    rows = [(3, " ".join(near)), (3, " ".join(near[:-1])), (4, " ".join(near))]
    got = jaccard.keep_first(docs(*rows), 5, 80, 100).collect()
    assert [r.doc_id for r in got] == [3]


def test_shuffle_path_gives_the_same(docs, monkeypatch):
    rows = corpus(4)
    want = brute(rows, 4, 85, 100)
    monkeypatch.setattr(shared, "FILTER_BITS", 6)                 # a filter that is soon full
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 200)
    assert found(docs(*rows), 4, 85, 100) == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (7, 7), (None, 3)],
                                  "a long, b long")
    got = {r.id: r.root for r in C.components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 45: 40, 50: 40}
