import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tillroll.llm import manifest as M
from tillroll.llm.shared import positions


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, tampered=False):
    text = row["text"]
    if tampered and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root, and for every node the siblings to its left and right, by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
        for path, k in zip(paths, range(len(at))):
            g, s = divmod(at[k], 8)
            path.append((runs[g][:s], runs[g][s + 1:]))
            at[k] = g
        nodes = [sha(*r) for r in runs]
    return nodes[0], paths


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    held = []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        held.append((own, *tree([leaf(r) for r in own])))
    root, tops = tree([subroot for _, subroot, _ in held])
    out = []
    for (own, subroot, paths), top in zip(held, tops):
        for r, path in zip(own, paths):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            folded = leaf(r, hit)
            for a, b in path + top:
                folded = sha(*a, folded, *b)
            proof = sha(*(h for a, b in path + top for h in a + b))
            out.append((r["doc_id"], leaf(r), subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def rows_of(n, langs, seed=4):
    rng = random.Random(seed)
    return [{"doc_id": rng.choice([i, i, i, None, 5]), "text": rng.choice(["Ab c", "x", "", None, "É Ü"]),
             "lang": rng.choice(langs), "source": rng.choice(["s", None]), "n_chars": rng.choice([3, None])}
            for i in range(n)]


@pytest.mark.parametrize("n,langs,top", [
    (200, ["en", "de", None, "é"], M.TOP_NODES),
    (200, ["en", "de", None], 3),                      # lower levels are joined, upper ones broadcast
    (40, [f"l{i}" for i in range(70)], 2),             # many trees, most of one leaf
    (1, ["en"], M.TOP_NODES), (9, ["en"], 0), (0, ["en"], M.TOP_NODES)])
def test_equals_plain_python(spark, docs, n, langs, top):
    rows = rows_of(n, langs)
    schema = docs().schema
    table = spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)
    got = M.manifest(table.withColumn("root", F.lit(1)), top).collect()
    assert sorted(map(tuple, got), key=repr) == (expected(rows) if rows else [])


def test_settings_are_given_back_and_nothing_stays_cached(spark, docs):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    M.manifest(docs((1, "a"), (2, "b"), (3, "c"))).collect()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == 0


def test_positions_of_hot_and_repeated_rows(spark):
    rows = [("a", i % 5) for i in range(300)] + [(None, i) for i in range(7)] + [("b", 1)]
    got = positions(spark.createDataFrame(rows, "pos_by string, v int"), ["pos_by"], [F.asc("v")]).collect()
    for by, n in (("a", 300), (None, 7), ("b", 1)):
        own = sorted((r["pos"], r["v"], r["total"]) for r in got if r["pos_by"] == by)
        assert [p for p, _, _ in own] == list(range(n)) and {t for _, _, t in own} == {n}
        assert [v for _, v, _ in own] == sorted(v for _, v, _ in own)
