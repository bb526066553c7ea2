import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import topk, urls

VEC = "vec_id long, embedding array<float>, label int"


def brute_top(rows, k, scale=1024):
    ok = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, done = [], set()
    for i, q in ok:
        if i % 10 or (i, tuple(q)) in done:
            continue
        done.add((i, tuple(q)))
        best = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q)))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) + (i % 7) / 5 for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(30)]                       # ties
    rows += [(2000, None), (2010, [None] * 8), (None, [0.1] * 8), (2020, [float("nan")] * 8),
             (2030, [float("inf")] + [0.0] * 7), (2040, [0.25, 0.5]), (2050, [0.75, -0.5]), (2060, []), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VEC).withColumn("score", F.lit(0)).repartition(3)
    want = brute_top(rows, 10)
    for block in (32_768, 5):
        monkeypatch.setattr(topk, "QUERY_BLOCK", block)
        got = sorted(map(tuple, topk.top_k(df, "vec_id % 10 = 0").collect()))
        assert got == want
    assert topk.top_k(spark.createDataFrame([], VEC), "vec_id % 10 = 0").count() == 0


def test_large_components_stay_exact():
    m = np.array([[2.0**40, 3.0], [1.0, -2.0**41]])
    q = np.array([2.0**20, 2.0**30])
    assert topk._scores(m, q).tolist() == [2**60 + 3 * 2**30, 2**20 - 2**71 if 2**71 < 2**63 else -2**63]


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"), ("block", "bad.org", "")]


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, None, "allow")
    return host, path, best[2], best[3]


def test_urls_equal_a_plain_version(spark):
    found = ["http://a.example.net/en/x?q=1", "https://EXAMPLE.com/de/1#t", "http://example.com/DE/", "ftp://x.org/fr/",
             "http://notexample.net", "http://net/", "http://net", "nonsense", "", None, "://host/p", "http:///path",
             "http://x.bad.org?y", "http://bad.org", "http://BAD.ORG/fr/a", "http://é.NET/Ä", "http://user@h.net:80/en/",
             "a://b://c.net/en/", "http://example.net/en", "http://.net/", "x\n://y.net/\nz"]
    df = spark.createDataFrame([(i, u, "<html>", "z") for i, u in enumerate(found)],
                               "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, RULES).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(found)}
    assert urls.judge_urls(df.limit(0), RULES).count() == 0


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda t: len(t))
    (tmp_path / "rules").write_bytes(urls.rule_table(RULES + [("block", "gro", "/fr/")]))
    table = urls.DigestArray(str(tmp_path / "rules"))
    at = table.find([b"org/fr/", b"gro/fr/", b"xxx/fr/", b"net/"])
    assert [None if j < 0 else table.text(j) for j in at] == [b"org/fr/", b"gro/fr/", None, b"net/"]


def test_unknown_verdict_is_refused():
    with pytest.raises(ValueError):
        urls.rule_table([("maybe", "net", "/")])
