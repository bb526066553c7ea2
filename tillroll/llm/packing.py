"""Packing of token pieces into as few fixed-length sequences as possible.

Documents are encoded and cut only where longer than a sequence.  Full pieces are
sequences of their own; the rest are items of a bin packing problem, dealt out
to blocks of a few thousand.  Each block is solved by a grouping genetic
algorithm on several islands: crossover injects whole well-filled bins of one
parent into the other, removes the bins that hold duplicates, and best-fits the
displaced items; after each epoch an island passes its elite on to the next one.
A block is finished as soon as it meets the lower bound ceil(tokens / capacity).
What the loosest sequence of each block holds is pooled and packed once more.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.shared import released, stored, tune
from tillroll.llm.tokens import encoded_segments

#: Items of a block on average; islands of a block; epochs; solutions of an island;
#: generations of an epoch; blocks whose loose ends are packed together.
BLOCK_ITEMS, ISLANDS, EPOCHS, POPULATION, GENERATIONS, POOLED = 4096, 2, 2, 4, 6, 64


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches):
        for batch in batches:
            docs = batch.column("doc_id")
            ids: list[list[bytes]] = [[] for _ in range(len(docs))]
            for first, counts, values, which in encoded_segments(batch.column("text"), path):
                if not len(which):
                    continue
                held = np.fromiter(map(len, values), np.int64, len(values)) // 4
                words = held[which]
                ends = np.cumsum(words)
                place = np.repeat((np.cumsum(held) - held)[which] - ends + words, words) + np.arange(ends[-1])
                stream = np.frombuffer(b"".join(values), "<u4")[place]
                cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    ids[first + k].append(stream[a:b].tobytes())
            rows = []
            for row, parts in enumerate(ids):
                whole = b"".join(parts) + end
                for p, a in enumerate(range(0, len(whole), step)):
                    body = whole[a:a + step]
                    rows.append((row, p, a // 4, len(body) // 4, zlib.crc32(body)))
            index, *rest = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
            rest = [pa.array(c, t) for c, t in zip(rest, (pa.int32(), *[pa.int64()] * 3))]
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(index)), *rest],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids, ``end_id``
    behind them, cut into pieces of ``capacity`` (only the last may be shorter).
    Null and empty texts are the end id alone."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(released(_pieces(path, capacity, end_id)),
                           "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths, order, room: list[int], capacity: int, assign: np.ndarray) -> None:
    """Put items (in this order) into the fullest bin that takes them; ``room`` is
    extended by new bins, ``assign`` gets the bins.  Bins are kept by their room,
    and a bit set of the rooms in use finds the least sufficient one."""
    by_room: dict[int, list[int]] = {}
    used = 0
    for b, r in enumerate(room):
        if r > 0:
            by_room.setdefault(r, []).append(b)
            used |= 1 << r
    for i in order:
        size = int(lengths[i])
        above = used >> size
        if above:
            r = size + (above & -above).bit_length() - 1
            bins = by_room[r]
            b = bins.pop()
            if not bins:
                used &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        r -= size
        room[b] = r
        assign[i] = b
        if r:
            by_room.setdefault(r, []).append(b)
            used |= 1 << r


def _compact(assign: np.ndarray) -> np.ndarray:
    return np.unique(assign, return_inverse=True)[1].astype(np.int32)


def _score(lengths: np.ndarray, assign: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller ones (mean square of the fill)."""
    fill = np.bincount(assign, lengths)
    return len(fill), -float(np.mean((fill / capacity) ** 2))


def cross(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Offspring of a: some of the best filled bins of b go in whole, bins of a
    that hold one of their items go out, displaced items are best-fitted."""
    fill = np.bincount(b, lengths)
    ranked = np.argsort(-fill, kind="stable")
    good = ranked[:max(1, len(ranked) // 2)]
    chosen = np.zeros(len(fill), bool)
    chosen[good[rng.random(len(good)) < 0.5]] = True
    injected = chosen[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[injected]] = True
    displaced = hit[a] & ~injected
    child = np.full(len(a), -1, np.int64)
    keep = ~injected & ~displaced
    child[keep] = a[keep]
    child[injected] = b[injected] + len(hit)
    child[~displaced] = _compact(child[~displaced])
    placed = child[~displaced]
    n = int(placed.max()) + 1 if len(placed) else 0
    room = (capacity - np.bincount(placed, lengths[~displaced], minlength=n)).astype(int).tolist()
    items = np.flatnonzero(displaced)
    best_fit(lengths, items[np.argsort(-lengths[items], kind="stable")], room, capacity, child)
    return _compact(child)


def evolve(lengths: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int) -> np.ndarray:
    """One epoch of an island: the best assignment of items to bins it finds."""
    rng = np.random.default_rng(seed)
    bound = -(-int(lengths.sum()) // capacity)
    people = [e for e in elites]
    decreasing = np.argsort(-lengths, kind="stable")
    while len(people) < POPULATION:
        noise = 0.0 if not people else 0.3
        order = decreasing if not noise else np.argsort(-lengths * (1 + noise * rng.random(len(lengths))))
        assign = np.zeros(len(lengths), np.int64)
        best_fit(lengths, order, [], capacity, assign)
        people.append(_compact(assign))
        if _score(lengths, people[-1], capacity)[0] == bound:
            return people[-1]
    rank = lambda x: _score(lengths, x, capacity)
    people.sort(key=rank)
    for _ in range(GENERATIONS):
        if rank(people[0])[0] == bound:
            break
        mates = rng.permutation(len(people))
        people += [cross(lengths, people[i], people[j], capacity, rng)
                   for i, j in zip(range(len(people)), mates) if i != j]
        people.sort(key=rank)
        del people[POPULATION:]
    return people[0]


def _epoch(capacity: int, epoch: int):
    def run(batches):
        for batch in batches:
            found, bins, score = [], [], []
            names = ("block", "island", "lengths", "own", "other")
            for block, island, lengths, *elites in zip(*(batch.column(k).to_pylist() for k in names)):
                lengths = np.array(lengths, np.int64)
                start = [np.frombuffer(e, np.int32) for e in elites if e is not None]
                best = evolve(lengths, start, capacity, hash((block, island, epoch)) & 0xFFFFFFFF)
                found.append(best.astype(np.int32).tobytes())
                n, s = _score(lengths, best, capacity)
                bins.append(n)
                score.append(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("island"), pa.array(found, pa.binary()),
                 pa.array(bins, pa.int64()), pa.array(score, pa.float64())],
                names=["block", "island", "best", "bins", "score"])
    return run


def _solve(items: DataFrame, capacity: int) -> DataFrame:
    """(block, uids, lengths, best) of items (block, uid, length)."""
    blocks = stored(items.groupBy("block")
                    .agg(F.sort_array(F.collect_list(F.struct("length", "uid"))).alias("i"))
                    .select("block", F.col("i.uid").alias("uids"), F.col("i.length").alias("lengths")),
                    "blocks")
    bound = F.ceil(F.expr("aggregate(lengths, 0L, (s, x) -> s + x)") / capacity)
    none = F.lit(None).cast("binary")
    work = blocks.select("block", F.explode(F.expr(f"sequence(0, {ISLANDS - 1})")).alias("island"),
                         "lengths", none.alias("own"), none.alias("other"))
    schema = "block long, island int, best binary, bins long, score double"
    best = None
    for epoch in range(EPOCHS):
        epoch_best = stored(work.select("block", "island", "lengths", "own", "other")
                            .repartition(F.col("block"), F.col("island"))
                            .mapInArrow(_epoch(capacity, epoch), schema), "islands")
        best = epoch_best if best is None else best.unionByName(epoch_best)
        if epoch + 1 < EPOCHS:
            still = (blocks.join(epoch_best.groupBy("block").agg(F.min("bins").alias("m")), "block")
                     .where(F.col("m") > bound).select("block", "lengths"))
            ring = epoch_best.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"),
                                     F.col("best").alias("other"))
            work = (still.join(epoch_best.select("block", "island", F.col("best").alias("own")), "block")
                    .join(ring, ["block", "island"]))
    chosen = best.groupBy("block").agg(F.min_by("best", F.struct("bins", "score", "island")).alias("best"))
    return blocks.join(chosen, "block")


def _placed(capacity: int, level: int, keep_loose: bool):
    """Rows of the solved blocks; those of a block's loosest bin are marked."""
    def run(batches):
        for batch in batches:
            out = []
            for block, uids, lengths, best in zip(*(batch.column(k).to_pylist()
                                                    for k in ("block", "uids", "lengths", "best"))):
                best, lengths = np.frombuffer(best, np.int32), np.array(lengths, np.int64)
                fill = np.bincount(best, lengths)
                loosest = int(np.argmin(fill)) if not keep_loose and fill.min() < capacity else -1
                order = np.argsort(best, kind="stable")
                sizes, bins = lengths[order], best[order]
                before = np.cumsum(sizes) - sizes
                first = np.concatenate(([True], bins[1:] != bins[:-1]))
                offset = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(bins))))
                sequence = ((block * 2 + level) * (1 << 20) + bins) * 2
                out.append(pa.table([pa.array(np.array(uids, np.int64)[order]), pa.array(sizes),
                                     pa.array(np.full(len(order), block)), pa.array(sequence.astype(np.int64)),
                                     pa.array(offset), pa.array(bins == loosest)],
                                    names=["uid", "length", "block", "sequence_id", "offset", "loose"]))
            if out:
                yield from pa.concat_tables(out).to_batches()
    return run


def pack(items: DataFrame, capacity: int = 4096) -> DataFrame:
    """(uid, sequence_id, offset) of stored ``items`` (uid unique, length from 1 to
    capacity); an empty table gives none."""
    full = items.where(F.col("length") == capacity).select(
        "uid", (F.col("uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    small = items.where(F.col("length") < capacity)
    blocks = -(-small.count() // BLOCK_ITEMS) or 1
    schema = "uid long, length long, block long, sequence_id long, offset long, loose boolean"
    dealt = small.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"))
    level = stored(_solve(dealt, capacity).mapInArrow(_placed(capacity, 0, blocks == 1), schema), "placed")
    loose = level.where("loose").select("uid", "length", F.expr(f"block div {POOLED}").alias("block"))
    rest = _solve(loose, capacity).mapInArrow(_placed(capacity, 1, True), schema)
    keep = ["uid", "sequence_id", "offset"]
    return full.unionByName(level.where("NOT loose").select(keep)).unionByName(rest.select(keep))


def packed_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every piece of every row of ``docs`` (doc_id, text; other columns ignored)
    with its sequence_id and its offset there (gapless from 0).  doc_id may be
    null or repeat: each row is packed.  An empty table has no pieces."""
    pieces = token_pieces(docs, path, capacity, end_id)
    pieces = stored(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces.select("uid", "length"), capacity), "uid").drop("uid")
