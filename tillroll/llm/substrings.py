"""Exact removal of repeated passages by suffix automata of reference shards.

A passage is repeated when ``window`` consecutive words also start earlier
(smaller doc_id, or the same document at a smaller word position).  Streaming
every document against automata of the whole corpus would cost one pass per
shard, so the shards hold only what can match:

1. Window hashes travel in packed cells; a task sends each hash once, with its
   first place there.  The merge tells, for every window that isn't the first of
   its hash, one earlier place.  Neighbouring windows join to runs.
2. The earlier places, united, are the reference passages; they are dealt out to
   shards of a bounded number of words.  The runs are the query passages of
   the shards that hold their references.  A shard with many queries goes to
   several tasks, its reference passages copied to each (a broadcast within
   the shard).
3. A task builds the word-level suffix automaton of its shard, references in
   order of place, and streams the queries through it: matching statistics give
   every position where ``window`` or more words match, the automaton's first
   end position says whether that is earlier.  Hashes only route; every
   removal is confirmed on the words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm import exchange as X
from tillroll.llm.shared import code_points, discard, free_name, released, shuffle_parts, split_by_keys, stored, tune
from tillroll.llm.textkit import gram_hashes, mix, word_hashes

#: Windows that a task gathers before it sends packed cells.
BLOCK_WINDOWS = 1_500_000
#: Reference words of a shard, and query words of one of its tasks, on average.
SHARD_WORDS, QUERY_WORDS = 60_000, 1_000_000

_RUNS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()),
                   ("refs", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary()),
                   ("rdocs", pa.binary()), ("rstarts", pa.binary())])
_RUNS_DDL = ("part int, keys binary, docs binary, refs binary, starts binary, sizes binary, "
             "rdocs binary, rstarts binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_RUNS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RUNS.types)], schema=_RUNS)


def _run_rows(doc, start, size, rdoc, rstart, parts: int) -> list[tuple]:
    """Runs dealt out by document, as packed rows; in each, neighbours are joined."""
    rows = []
    home = (mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((start, doc, home))
    home, doc, start, size, rdoc, rstart = (x[order] for x in (home, doc, start, size, rdoc, rstart))
    doc, start, size, rdoc, rstart, first = _joined(doc, start, size, rdoc, rstart)
    home = home[first]
    cuts = np.searchsorted(home, np.arange(parts + 1))
    for part in range(parts):
        a, b = cuts[part], cuts[part + 1]
        if b > a:
            rows.append((part, None, X.pack_ids(doc[a:b]), None, X.pack_ids(start[a:b]),
                         X.pack_ints(size[a:b]), X.pack_ids(rdoc[a:b]), X.pack_ids(rstart[a:b])))
    return rows


def _joined(doc, start, size, rdoc, rstart):
    """Runs sorted by place with neighbours joined where their references are
    neighbours too; also the index of each joined run's first part."""
    if not len(doc):
        return doc, start, size, rdoc, rstart, np.zeros(0, np.int64)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = ((doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + size[:-1])
               | (rdoc[1:] != rdoc[:-1]) | (rstart[1:] != rstart[:-1] + size[:-1]))
    first = np.flatnonzero(new)
    return doc[first], start[first], np.add.reduceat(size, first), rdoc[first], rstart[first], first


def _window_cells(window: int, parts: int):
    def block(texts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        texts.sort(key=lambda x: x[0])
        ids = np.array([i for i, _ in texts], np.int64)
        sizes = np.array([len(h) for _, h in texts])
        hashes = np.concatenate([h for _, h in texts])
        owner = np.repeat(np.arange(len(texts)), sizes)
        start = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(hashes, kind="stable")            # ties stay in order of place
        hashes, owner, start = hashes[order], owner[order], start[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        first = np.flatnonzero(new)
        back = first[np.cumsum(new) - 1]
        doc = ids[owner]
        later = ~new & ((doc != doc[back]) | (start != start[back]))
        rows = []
        if later.any():
            rows = _run_rows(doc[later], start[later], np.ones(int(later.sum()), np.int64),
                             doc[back[later]], start[back[later]], parts)
        cuts = np.searchsorted(X.part_of(hashes[first], parts), np.arange(parts + 1))
        for part in range(parts):
            mine = first[cuts[part]:cuts[part + 1]]
            if len(mine):
                own, ref = np.unique(owner[mine], return_inverse=True)
                rows.append((part, X.pack_sorted(hashes[mine]), X.pack_ids(ids[own]), X.pack_ints(ref),
                             X.pack_ints(start[mine]), None, None, None))
        return _batch(rows)

    def run(batches):
        texts, total = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for row, words, counts in word_hashes(batch.column("text")):
                grams, at = gram_hashes(words, window), 0
                for k, n in enumerate(counts.tolist()):
                    if n >= window:
                        texts.append((ids[row + k], grams[at:at + n - window + 1]))
                        total += n - window + 1
                    at += n
                if total >= BLOCK_WINDOWS:
                    yield block(texts)
                    texts, total = [], 0
        if texts:
            yield block(texts)
    return run


def _later_windows(parts: int):
    """Merge a partition's cells: every place but the first of its hash, with that
    first place.  Runs found within one task only pass through."""
    def run(batches):
        keys, docs, starts = [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["keys"] is None:
                    yield _batch([tuple(row[k] for k in _RUNS.names)])
                    continue
                keys.append(X.unpack_sorted(row["keys"]))
                docs.append(X.unpack_ids(row["docs"])[X.unpack_ints(row["refs"]).astype(np.int64)])
                starts.append(X.unpack_ints(row["starts"]).astype(np.int64))
        if not keys:
            return
        key, doc, start = map(np.concatenate, (keys, docs, starts))
        del keys, docs, starts
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key) + 1, dtype=bool)
        same[1:-1] = key[order[1:]] == key[order[:-1]]
        order = order[same[1:] | same[:-1]]
        key, doc, start = key[order], doc[order], start[order]
        order = np.lexsort((start, doc, key))
        key, doc, start = key[order], doc[order], start[order]
        if len(key):
            new = np.concatenate(([True], key[1:] != key[:-1]))
            back = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = ~new & ((doc != doc[back]) | (start != start[back]))
            if later.any():
                yield _batch(_run_rows(doc[later], start[later], np.ones(int(later.sum()), np.int64),
                                       doc[back[later]], start[back[later]], parts))
    return run


def _runs(batches):
    found = []
    for batch in batches:
        for row in batch.to_pylist():
            found.append((X.unpack_ids(row["docs"]), X.unpack_ids(row["starts"]),
                          X.unpack_ints(row["sizes"]).astype(np.int64),
                          X.unpack_ids(row["rdocs"]), X.unpack_ids(row["rstarts"])))
    if found:
        columns = [np.concatenate(c) for c in zip(*found)]
        order = np.lexsort((columns[1], columns[0]))
        doc, start, size, rdoc, rstart, _ = _joined(*(c[order] for c in columns))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc, start, size, rdoc, rstart)],
                                         names=["doc_id", "start", "size", "ref_doc", "ref_start"])


class SuffixAutomaton:
    """Suffix automaton of several word sequences; each state keeps the first
    place (in order of insertion) where its words end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.place = [-1], [0], [-1]

    def add(self, words: list, places) -> None:
        """Insert a sequence; ``places`` gives the place of each of its words."""
        nxt, link, length, place = self.next, self.link, self.length, self.place
        last = 0
        for word, here in zip(words, places):
            seen = nxt[last].get(word)
            if seen is not None and length[seen] == length[last] + 1:
                last = seen
                continue
            if seen is not None:
                last = self._split(last, seen, word)
                continue
            state = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            place.append(here)
            link.append(0)
            at = last
            while at != -1 and word not in nxt[at]:
                nxt[at][word] = state
                at = link[at]
            if at != -1:
                target = nxt[at][word]
                link[state] = target if length[target] == length[at] + 1 else self._split(at, target, word)
            last = state

    def _split(self, at: int, target: int, word) -> int:
        """A copy of ``target`` for the shorter words that end in ``at`` + word."""
        clone = len(self.next)
        self.next.append(dict(self.next[target]))
        self.length.append(self.length[at] + 1)
        self.place.append(self.place[target])
        self.link.append(self.link[target])
        self.link[target] = clone
        while at != -1 and self.next[at].get(word) == target:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def ends(self, words: list, least: int):
        """(index, place): the ``least`` words up to index occur, first ending at place."""
        nxt, link, length, place = self.next, self.link, self.length, self.place
        state = size = 0
        for i, word in enumerate(words):
            step = nxt[state].get(word)
            while step is None and state:
                state = link[state]
                size = length[state]
                step = nxt[state].get(word)
            if step is None:
                continue
            state, size = step, size + 1
            while length[link[state]] >= least:       # only the last words decide
                state = link[state]
            size = min(size, length[state])
            if size >= least:
                yield i, place[state]


def _pieces(window: int):
    """Query and reference passages of the documents that have some."""
    schema = pa.schema([("shard", pa.int64()), ("salt", pa.int64()), ("ref", pa.bool_()),
                        ("doc_id", pa.int64()), ("start", pa.int64()), ("words", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, wanted in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "wanted"))):
                words = (text or "").encode().split()
                groups: dict[tuple, list] = {}
                for w in wanted:
                    groups.setdefault((w["shard"], w["salt"], w["salts"]), []).append((w["start"], w["stop"]))
                for (shard, salt, salts), ranges in groups.items():
                    for a, b in united(ranges):
                        body = b" ".join(words[a:b])
                        if salts is None:
                            rows.append((shard, salt, False, doc, a, body))
                        else:
                            rows += [(shard, s, True, doc, a, body) for s in range(salts)]
            columns = list(zip(*rows)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)],
                                             schema=schema)
    return run


def united(ranges) -> list[list[int]]:
    """Ascending ranges (start, stop) with overlapping ones made one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _mark(words: list[bytes]) -> int:
    """Names the words of a span, so that it is applied to a text that holds them there."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words))).astype(np.int64))


def held_spans(words: list[bytes], spans) -> list[list[int]]:
    """The ranges, united, of the spans whose words stand there in this text."""
    return united((s["start"], s["stop"]) for s in spans if _mark(words[s["start"]:s["stop"]]) == s["mark"])


def _stream(window: int):
    """One shard (or a slice of its queries): confirmed spans of its queries."""
    names = ["doc_id", "start", "stop", "mark"]

    def run(key, table):
        refs = table.filter(table.column("ref")).sort_by([("doc_id", "ascending"), ("start", "ascending")])
        machine, places = SuffixAutomaton(), []
        for doc, start, words in zip(*(refs.column(k).to_pylist() for k in ("doc_id", "start", "words"))):
            words = words.split(b" ")
            machine.add(words, range(len(places), len(places) + len(words)))
            places += [(doc, start + i) for i in range(len(words))]
        out = []
        queries = table.filter(pc.invert(table.column("ref")))
        for doc, start, words in zip(*(queries.column(k).to_pylist() for k in ("doc_id", "start", "words"))):
            span, first, words = None, len(out), words.split(b" ")
            for i, place in machine.ends(words, window):
                rdoc, last = places[place]
                begin = start + i - window + 1
                if (rdoc, last - window + 1) < (doc, begin):
                    if span is not None and begin <= span[2]:
                        span[2] = begin + window
                    else:
                        span = [doc, begin, begin + window]
                        out.append(span)
            for span in out[first:]:
                span.append(_mark(words[span[1] - start:span[2] - start]))
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)
    return run


def repeated_spans(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, spans): word ranges (start, stop) to remove, ascending, each with a mark of its
    words (:func:`held_spans`), of each document that has some.

    ``docs`` needs doc_id and text; other columns are ignored.  A document is
    named by its doc_id: rows repeating it aren't earlier than each other at the same
    word position; if their texts differ, a span is cut from those that hold its words
    there.  Rows without doc_id, text or ``window`` words are
    neither reference nor changed.  An empty table has no spans.
    """
    spark = tune(docs.sparkSession)
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = shuffle_parts(spark)
    runs = (docs.mapInArrow(released(_window_cells(window, parts)), _RUNS_DDL).repartitionById(parts, "part")
            .mapInArrow(released(_later_windows(parts)), _RUNS_DDL).repartitionById(parts, "part")
            .mapInArrow(released(_runs), "doc_id long, start long, size long, ref_doc long, ref_start long"))
    runs = stored(runs, "runs")
    longer = F.lit(window - 1)
    refs = stored(runs.groupBy("ref_doc", "ref_start").agg(F.max("size").alias("size"))
                  .select(F.col("ref_doc").alias("doc_id"), F.col("ref_start").alias("start"),
                          (F.col("ref_start") + F.col("size") + longer).alias("stop")), "references")
    total = refs.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0
    shards = -(-total // SHARD_WORDS) or 1
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards))
    queries = runs.select("doc_id", "start", (F.col("start") + F.col("size") + longer).alias("stop"),
                          shard("ref_doc").alias("shard"))
    salts = stored(queries.groupBy("shard").agg(
        F.ceil(F.sum(F.col("stop") - F.col("start")) / QUERY_WORDS).cast("long").alias("salts")), "salts")
    pick = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("salts"))
    none = F.lit(None).cast("long")
    wanted = (queries.join(salts, "shard")
              .select("doc_id", "start", "stop", "shard", pick.alias("salt"), none.alias("salts"))
              .unionByName(refs.withColumn("shard", shard("doc_id")).join(salts, "shard")
                           .select("doc_id", "start", "stop", "shard", none.alias("salt"), "salts"))
              .groupBy("doc_id")
              .agg(F.collect_set(F.struct("start", "stop", "shard", "salt", "salts")).alias("wanted")))
    wanted = stored(wanted, "passages")
    some, _ = split_by_keys(docs, wanted, "doc_id")
    pieces = some.join(wanted, "doc_id").mapInArrow(
        released(_pieces(window)), "shard long, salt long, ref boolean, doc_id long, start long, words binary")
    spans = pieces.groupBy("shard", "salt").applyInArrow(
        _stream(window), "doc_id long, start long, stop long, mark long")
    spans = stored(spans.groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop", "mark"))).alias("spans")), "spans")
    discard(runs, refs, salts, wanted)
    return spans


def _digest(batches):
    for batch in batches:
        sizes, gone, digests = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            words = (text or "").encode().split()
            sizes.append(len(words))
            if spans:
                kept, at = [], 0
                for a, b in held_spans(words, spans):
                    kept += words[at:a]
                    at = b
                words = kept + words[at:]
            gone.append(sizes[-1] - len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
             pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def removal_digest(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; null text is empty."""
    spans = repeated_spans(docs, window)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_spans(docs, spans, "spans").select("doc_id", "text", "spans").mapInArrow(
        released(_digest), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def with_spans(docs: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """``docs`` with their spans (null: none) as column ``name``.  Only texts of
    documents that have some are shuffled."""
    spans = spans.withColumnRenamed("spans", name)
    some, rest = split_by_keys(docs, spans, "doc_id")
    return some.join(spans, "doc_id", "left").select(*docs.columns, name).unionByName(
        rest.withColumn(name, F.lit(None).cast(spans.schema[name].dataType)))


def without_spans(text: str, spans) -> str:
    """``text`` without the words in ``spans``, and the white space after them."""
    import re

    if not spans:
        return text
    starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
    out, at = [], 0
    for a, b in held_spans(text.encode().split(), spans):
        out.append(text[at:starts[a]])
        at = starts[min(b, len(starts) - 1)]
    return "".join(out) + text[at:]


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` (doc_id, text, any other columns, n_chars if present brought up
    to date) with repeated passages cut from the texts; every row stays."""
    spans = repeated_spans(docs, window)
    names = docs.columns
    hidden = free_name("spans", names)
    out = with_spans(docs, spans, hidden)

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: without_spans(t, s.tolist() if s is not None else None))

    cut_text = F.when(F.col(hidden).isNull(), F.col("text")).otherwise(cut("text", hidden))
    out = out.withColumn("text", cut_text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", code_points("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)
