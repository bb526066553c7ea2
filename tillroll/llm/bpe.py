"""Byte-level BPE encoding and decoding by ranked merges.

The words of a text are the matches of the tokenizer's splitting pattern.  Most
occurrences are of few words: the most frequent distinct words of the corpus are
encoded once, by a fold of Spark higher-order functions that merges the pair of
lowest rank until none is left (ranks are a literal map, held in small buckets
by CRC so that a lookup reads a dozen keys).  Their ids go to every task as a
table of bounded size; words outside it are merged in place by the same rule.
Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.shared import stored, tune
from tillroll.llm.textkit import CHECK, _hash_segment, segments, text_buffer

#: Words of the broadcast dictionary, their greatest length in bytes, and the
#: buckets of the literal rank map.
DICTIONARY, DICTIONARY_BYTES, BUCKETS = 262_144, 48, 4096
#: Words that a worker remembers (in each of two generations).
REMEMBERED = 150_000

LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
_KINDS: list[np.ndarray] = []
_RANKS: dict[str, tuple[dict, list]] = {}


def load_ranks(path: str) -> tuple[dict[bytes, int], dict[int, bytes]]:
    """Ranks by piece and pieces by rank of a rank file (base64 piece, rank)."""
    if path not in _RANKS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _RANKS[path] = ranks, {r: p for p, r in ranks.items()}
    return _RANKS[path]


def _kinds() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    if not _KINDS:
        table = np.full(0x110000, OTHER, np.uint8)
        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, points))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
            for m in regex.finditer(pattern, text):
                table[points[m.start()]:points[m.end() - 1] + 1] = kind
        table[0xD800:0xE000] = OTHER
        _KINDS.append(table)
    return _KINDS[0]


def split_words(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where words begin in ``points`` (code points of texts that begin at
    ``cuts``), by the usual pattern of byte-level BPE: contractions; a run of
    letters, of numbers or of other signs, with one space before it; white
    space, of which the last sign before a word is left to that word if it is a
    space, and stands alone otherwise."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _kinds()[points]
    edge = np.zeros(n, bool)
    edge[cuts[cuts < n]] = True
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new |= edge                                   # runs of one class within a text
    blank = kind == BLANK
    begin = new.copy()
    follows = np.zeros(n, bool)                   # a blank directly before a word of its text
    follows[:-1] = blank[:-1] & ~blank[1:] & ~edge[1:]
    begin |= follows                              # the last blank is split from its run
    joins = follows & (points == 0x20)
    begin[1:] &= ~joins[:-1]                      # and a space goes with the word
    # contractions: a single apostrophe that begins a word, before certain letters
    quote = np.flatnonzero((points == 0x27) & begin)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~edge[quote + 1]]
    if len(quote):
        low = points[quote + 1]
        two = np.zeros(len(quote), np.int64)
        has = quote + 2 < n
        third = points[np.minimum(quote + 2, n - 1)]
        has &= ~edge[np.minimum(quote + 2, n - 1)]
        pair = lambda a, b: (low == ord(a)) & (third == ord(b)) & has
        two[pair("r", "e") | pair("v", "e") | pair("l", "l")] = 2
        one = np.isin(low, [ord(c) for c in "stmd"])
        size = np.where(one, 1, two)
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        stop = quote + 1 + size
        inside = stop < n
        begin[stop[inside]] = True
    return np.flatnonzero(begin)


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank, leftmost first, is merged
    until no pair has a rank.  A queue keeps long words at n log n."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    if n < 40:
        parts = [word[i:i + 1] for i in range(n)]
        while len(parts) > 1:
            found = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            best = min(found)
            if best == 1 << 60:
                break
            i = found.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]
    stop, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    queue: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            rank = ranks.get(word[i:stop[j]])
            if rank is not None:
                heapq.heappush(queue, (rank, i, stop[i], stop[j]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, mid, end = heapq.heappop(queue)
        j = after[i]
        if not alive[i] or stop[i] != mid or j >= n or stop[j] != end:
            continue
        alive[j] = False
        stop[i], after[i] = stop[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [ranks[word[i:stop[i]]] for i in range(n) if alive[i]]


def fold_merges(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(word, ids) of distinct ``words`` (word binary): the merges as a fold of
    higher-order functions over each word's byte array.  Pieces are written in
    hex; the state holds them and the rank of each adjacent pair."""
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    literal = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
    none = F.lit(2**31 - 1)

    def fold(table):
        def rank(piece):
            return F.try_element_at(F.get(table, (F.crc32(piece) % BUCKETS).cast("int")), piece)

        def pair(a, b):
            return F.coalesce(rank(F.concat(a, b)), none)

        def step(state, _):
            p, r = state["p"], state["r"]
            low = F.array_min(r)
            i = F.array_position(r, low).cast("int")              # pieces i and i + 1, from 1
            size = F.size(p)
            both = F.concat(F.get(p, i - 1), F.get(p, i))
            left = F.when(i > 1, F.concat(F.slice(r, 1, F.greatest(i - 2, F.lit(0))),
                                          F.array(pair(F.get(p, i - 2), both)))).otherwise(F.slice(r, 1, 0))
            right = F.when(i + 1 < size, F.concat(F.array(pair(both, F.get(p, i + 1))),
                                                  F.slice(r, i + 2, F.greatest(size - i - 2, F.lit(0))))
                           ).otherwise(F.slice(r, 1, 0))
            merged = F.concat(F.slice(p, 1, i - 1), F.array(both),
                              F.slice(p, i + 2, F.greatest(size - i - 1, F.lit(0))))
            return F.when((F.size(r) > 0) & (low < none),
                          F.struct(merged.alias("p"), F.concat(left, right).alias("r"))).otherwise(state)

        places = lambda first, last: F.when(
            F.size("p") > 1, F.sequence(F.lit(first), F.size("p") - last)).otherwise(F.array().cast("array<int>"))
        start = F.struct(F.col("p"), F.transform(
            places(0, 2), lambda i: pair(F.get("p", i), F.get("p", i + 1))).alias("r"))
        whole = rank(F.hex("word"))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(
            F.aggregate(places(2, 0), start, step, lambda s: s["p"]), rank))

    pieces = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.hex(F.substring("word", i, F.lit(1))))
    # the map is named once in the plan: every mention of it is printed whole in Spark's event log
    return words.select("word", pieces.alias("p")).select(
        "word", F.transform(F.array(literal), fold)[0].alias("ids"))


def _segments_of_words(column: pa.Array):
    """Yield (first row, byte buffer, word starts, word ends, hashes, counts of the
    rows).  Texts are whole: only runs of texts are cut."""
    data, offsets = text_buffer(column)
    for first, last in segments(offsets):
        lo, hi = int(offsets[first]), int(offsets[last])
        part = data[lo:hi]
        points = np.frombuffer(part.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"),
                               np.uint32)
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        cuts = offsets[first:last + 1] - lo
        begins = split_words(points, np.searchsorted(at, cuts[:-1]))
        starts = at[begins]
        ends = np.append(starts[1:], hi - lo) if len(starts) else starts
        counts = np.diff(np.searchsorted(starts, cuts))
        yield first, part, starts, ends, _hash_segment(part, starts, ends), counts


def _distinct_words(batches):
    for batch in batches:
        words, counts = [], []
        for _, part, starts, ends, hashes, _ in _segments_of_words(batch.column("text")):
            _, first, held = np.unique(hashes, return_index=True, return_counts=True)
            short = ends[first] - starts[first] <= DICTIONARY_BYTES
            first, raw = first[short], part.tobytes()
            words += [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            counts += held[short].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())],
                                         names=["word", "n"])


class _Words:
    """A task's memory of words: ids as text, their number, and the decoded bytes."""

    def __init__(self, path: str, table) -> None:
        self.ranks, self.pieces = load_ranks(path)
        self.keys, self.checks, self.ids, self.cuts = table
        self.recent: dict[int, tuple] = {}
        self.older: dict[int, tuple] = {}

    def values(self, keys: np.ndarray, checks: np.ndarray, words) -> list[tuple]:
        """Of distinct words with these hashes, confirmed by second ones; ``words(i)``
        gives the bytes."""
        out = []
        places = np.searchsorted(self.keys, keys)
        hit = places < len(self.keys)
        hit[hit] = (self.keys[places[hit]] == keys[hit]) & (self.checks[places[hit]] == checks[hit])
        rows = zip(keys.tolist(), checks.tolist(), places.tolist(), hit.tolist())
        for i, (k, check, place, known) in enumerate(rows):
            v = self.recent.get(k)
            if v is None:
                v = self.older.get(k)
            if v is None or v[3] != check:
                ids = (self.ids[self.cuts[place]:self.cuts[place + 1]].tolist() if known
                       else merge_word(words(i), self.ranks))
                v = (" ".join(map(str, ids)).encode(), len(ids),
                     b"".join([self.pieces[x] for x in ids]), check)
            self.recent[k] = v
            out.append(v)
        if len(self.recent) > REMEMBERED:
            self.older, self.recent = self.recent, {}
        return out


def _round_trip(path: str, table):
    def run(batches):
        memory = _Words(path, table.value)
        for batch in batches:
            rows = []
            for _, part, starts, ends, hashes, counts in _segments_of_words(batch.column("text")):
                keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
                raw = part.tobytes()
                checks = _hash_segment(part, starts[first], ends[first], CHECK)
                values = memory.values(keys, checks, lambda i: raw[starts[first[i]]:ends[first[i]]])
                texts, sizes, decoded, _ = zip(*values) if values else ((), (), (), ())
                size, at, which = np.array(sizes, np.int64), 0, which.tolist()
                for n in counts.tolist():
                    mine = which[at:at + n]
                    at += n
                    rows.append((int(size[mine].sum()) if mine else 0,
                                 hashlib.sha256(b" ".join([texts[w] for w in mine])).hexdigest(),
                                 hashlib.sha256(b"".join([decoded[w] for w in mine])).hexdigest()))
            n, ids, back = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def dictionary(docs: DataFrame, path: str, size: int = DICTIONARY) -> DataFrame:
    """(word, ids) of at most ``size`` of the most frequent distinct words of at
    most ``DICTIONARY_BYTES`` bytes, counted over all documents: all words above
    the least count (by eighths of a power of two) that leaves no more."""
    counted = stored(docs.select("text").mapInArrow(_distinct_words, "word binary, n long")
                     .groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    grade = F.floor(F.log2("n") * 8)
    held = counted.groupBy(grade.alias("g")).agg(F.count("*").alias("words")).collect()   # 512 rows at most
    least, total = 512, 0
    for g, words in sorted(map(tuple, held), reverse=True):
        if total + words > size:
            break
        least, total = g, total + words
    top = counted.where(grade >= least).select("word")
    return stored(fold_merges(top.repartition(spark_parts(docs.sparkSession)), load_ranks(path)[0]), "word-ids")


def spark_parts(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)


def _packed(known: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words in ascending order, the hashes that confirm them, their ids in
    a row, and where the ids of each word begin (of a table of bounded size)."""
    table = known.toArrow().combine_chunks()
    words = table.column("word").combine_chunks().cast(pa.large_binary())
    if not len(words):
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int32), np.zeros(1, np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)
    cuts = np.frombuffer(words.buffers()[1], np.int64)[:len(words) + 1]
    keys, checks = (np.concatenate([
        _hash_segment(raw[cuts[a]:cuts[b]], cuts[a:b] - cuts[a], cuts[a + 1:b + 1] - cuts[a], seed)
        for a, b in segments(cuts)]) for seed in (0, CHECK))
    order = np.argsort(keys)
    lists = table.column("ids").combine_chunks().take(pa.array(order))
    lengths = np.array(pc.list_value_length(lists), np.int64)
    return keys[order], checks[order], np.array(lists.flatten(), np.int32), np.concatenate(([0], np.cumsum(lengths)))


def round_trip(docs: DataFrame, path: str, size: int = DICTIONARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``
    (doc_id, text; other columns ignored): the ids of the whole text, and the
    bytes that they decode to.  Null text is empty; doc_id may be null or
    repeat; texts that look like special tokens are ordinary text."""
    spark = tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = spark.sparkContext.broadcast(_packed(dictionary(docs, path, size)))
    return docs.mapInArrow(_round_trip(path, table),
                           "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
