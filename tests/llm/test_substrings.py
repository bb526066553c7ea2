import hashlib
import random
import re

from pyspark.sql import functions as F

from tillroll.llm import substrings as S


def brute(rows, window):
    places, out = {}, {}
    texts = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i in sorted(k for k in texts if k is not None):
        w = texts[i]
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if key in places:
                gone.update(range(s, s + window))
            else:
                places[key] = (i, s)
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["é", "日本"]
    passages = [[rng.choice(words) for _ in range(rng.randint(5, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        body = []
        for _ in range(rng.randint(0, 4)):
            body += [rng.choice(words) for _ in range(rng.randint(0, 30))]
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            body += p[a:] if rng.random() < 0.5 else p
        rows.append((i, rng.choice([" ", "\n", "  "]).join(body)))
    rows.append((n, " ".join(["same"] * 100)))
    rng.shuffle(rows)
    return rows


def found(df, window):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.removal_digest(df, window).collect()}


def test_equals_brute_force(docs, monkeypatch):
    for seed in (1, 2):
        rows = corpus(seed)
        assert found(docs(*rows), 20) == brute(rows, 20)
    monkeypatch.setattr(S, "BLOCK_WINDOWS", 100)
    monkeypatch.setattr(S, "SHARD_WORDS", 50)
    monkeypatch.setattr(S, "QUERY_WORDS", 200)
    rows = corpus(3)
    assert found(docs(*rows).repartition(5), 20) == brute(rows, 20)


def test_automaton_matches_a_plain_search():
    rng = random.Random(4)
    for _ in range(60):
        refs = [[rng.choice("abc") for _ in range(rng.randint(1, 25))] for _ in range(4)]
        machine, at = S.SuffixAutomaton(), 0
        firsts = {}
        for ref in refs:
            machine.add(ref, range(at, at + len(ref)))
            for i in range(len(ref) - 3):
                firsts.setdefault(tuple(ref[i:i + 4]), at + i + 3)
            at += len(ref)
        query = [rng.choice("abcd") for _ in range(60)]
        want = [(i, firsts[tuple(query[i - 3:i + 1])]) for i in range(3, 60) if tuple(query[i - 3:i + 1]) in firsts]
        assert list(machine.ends(query, 4)) == want


def test_nulls_repeats_empty_and_text(docs, spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, "head\n" + text + " tail"), (3, None), (None, text), (4, "")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed)
                 for r in S.removal_digest(docs(*rows), 20).collect())
    assert got == [(-1, 30, 0), (1, 30, 0), (1, 30, 0), (2, 32, 30), (3, 0, 0), (4, 0, 0)]
    out = S.remove_repeats(docs(*rows).withColumn("spans", F.lit("x")), 20)
    assert out.columns[-1] == "spans"
    by = {r.doc_id: r for r in out.collect()}
    assert by[2].text == "head\ntail" and by[2].n_chars == 9 and by[1].text == text and by[3].text is None
    assert S.removal_digest(docs(), 20).count() == 0


def test_rows_of_one_id_with_different_texts(docs):
    """A span is cut only from the row that holds its words."""
    passage = " ".join(f"p{i}" for i in range(30))
    clean = " ".join(f"c{i}" for i in range(60))
    rows = [(2, passage), (9, passage + " and a tail"), (9, clean), (9, "head " + passage)]
    out = sorted(r.text for r in S.remove_repeats(docs(*rows)).collect() if r.doc_id == 9)
    assert out == sorted(["and a tail", clean, "head "])
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in S.removal_digest(docs(*rows)).collect())
    assert got == [(2, 30, 0), (9, 31, 30), (9, 33, 30), (9, 60, 0)]
