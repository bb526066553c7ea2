"""Block and allow rules for urls, by a sorted digest array.

A rule list is laid out as one file: the 64-bit xxhash of each rule in ascending
order, its verdict, and the full rule strings.  Spark ships the file to the
executors, whose workers map it into memory (one copy a machine, however long
the list) and probe all candidate rules of a batch by vectorised binary search;
a hit counts only if the stored string is equal.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from tillroll.llm.shared import tune
from tillroll.session import ensure_checkpoint_dir

_HEAD = 4                                    # rules, path lengths, bytes of strings, unused
_URL = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    found = _URL.match(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def rule_table(rules: list[tuple[str, str, str]]) -> bytes:
    """The file of rules (verdict, host, path); of a rule given twice, block wins."""
    verdicts: dict[bytes, int] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        text = (host.translate(_LOWER) + path).encode()
        verdicts[text] = max(verdicts.get(text, 0), int(verdict == "block"))
    texts = sorted(verdicts, key=lambda t: (xxhash.xxh64_intdigest(t), t))
    lengths = sorted({len(path) for _, _, path in rules})
    head = np.array([len(texts), len(lengths), sum(map(len, texts)), 0], np.int64)
    return b"".join((head.tobytes(), np.array(lengths, np.int64).tobytes(),
                     np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).tobytes(),
                     np.cumsum([0, *map(len, texts)]).astype(np.int64).tobytes(),
                     np.array([verdicts[t] for t in texts], np.uint8).tobytes(), b"".join(texts)))


class DigestArray:
    """A rule file mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, k, _, _ = raw[:8 * _HEAD].view(np.int64).tolist()
        cuts = np.cumsum([8 * _HEAD, 8 * k, 8 * n, 8 * (n + 1), n]).tolist()
        self.lengths = raw[cuts[0]:cuts[1]].view(np.int64).tolist()
        self.keys = raw[cuts[1]:cuts[2]].view(np.uint64)
        self.begins = raw[cuts[2]:cuts[3]].view(np.int64)
        self.block = raw[cuts[3]:cuts[4]]
        self.texts = raw[cuts[4]:]

    def find(self, candidates: list[bytes]) -> list[int]:
        """Index of each candidate among the rules, or -1."""
        keys = np.array([xxhash.xxh64_intdigest(c) for c in candidates], np.uint64)
        at = np.searchsorted(self.keys, keys)
        out = [-1] * len(candidates)
        hit = np.flatnonzero(at < len(self.keys))
        for i in hit[self.keys[at[hit]] == keys[hit]].tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:      # equal digests: compare the strings
                if self.text(j) == candidates[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def text(self, j: int) -> bytes:
        return self.texts[self.begins[j]:self.begins[j + 1]].tobytes()


def candidates_of(host: str, path: str, lengths: list[int]):
    """All rules that would fit: the host and its parent domains, with the
    beginnings of the path that have the length of some rule's."""
    for n in lengths:
        if n <= len(path):
            for i in [0, *(m.end() for m in re.finditer(r"\.", host))]:
                yield (host[i:] + path[:n]).encode()


def _judge(name: str, default: str):
    def run(batches):
        table = DigestArray(SparkFiles.get(name))
        for batch in batches:
            hosts, paths, tried, owner = [], [], [], []
            for i, url in enumerate(batch.column("url").to_pylist()):
                host, path = split_url(url)
                hosts.append(host)
                paths.append(path)
                own = list(candidates_of(host, path, table.lengths)) if host else []
                tried += own
                owner += [i] * len(own)
            best: list[tuple] = [(-1, -1, -1)] * len(hosts)
            for i, text, j in zip(owner, tried, table.find(tried)):
                if j >= 0:
                    best[i] = max(best[i], (len(text), (text + b"/").find(b"/"), j))
            rules = [None if j < 0 else table.text(j).decode() for _, _, j in best]
            verdicts = [default if j < 0 else ("allow", "block")[table.block[j]] for _, _, j in best]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(hosts), pa.array(paths),
                 pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])
    return run


def ship(spark: SparkSession, content: bytes) -> str:
    """Put the rule file into the shared folder and have Spark deliver it to every
    executor (also to later ones); gives its name there."""
    name = f"url-rules-{hashlib.sha256(content).hexdigest()[:24]}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    for i in range(0, len(content), 1 << 20):
        out.write(bytearray(content[i:i + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url;
    other columns ignored).

    Rules are (verdict, host, path): one fits its host and all subdomains where
    the url's path begins with its path.  The longest fitting rule decides (of
    equally long ones that of the longer host), otherwise ``default``.  A null
    url, or one without ``://``, has an empty host and path and fits no rule.
    """
    spark = tune(pages.sparkSession)
    name = ship(spark, rule_table(rules))
    return pages.select("page_id", "url").mapInArrow(
        _judge(name, default), "page_id long, host string, path string, rule string, verdict string")
