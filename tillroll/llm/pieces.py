"""Encoding and decoding with a byte-pair piece model by vectorised merge rounds.

A text becomes one space, then the text, with every space written as the blank sign;
no piece has a blank behind another character, so each blank (or run of blanks) with
the characters behind it is a word of its own, and equal words have equal ids.  The
words that a task hasn't met lately are encoded together: their characters stand in one
flat array of symbols, and in every round the pair of best rank of each word is merged
at all its places, from the left, until no word has a pair left.

A round may merge all places of a pair at once only where merging one can't bring
up a pair that goes before the others; pieces for which it can (``early``) are
merged at their first place only.  In words of more than ``WINDOW_FROM`` characters, places
count as best if no better pair lies within the length of a piece: what happens
farther away can't reach them.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.shared import tune
from tillroll.llm.textkit import CHECK, _hash_segment, distinct_words, text_buffer

BLANK = "▁"
#: Words that a worker remembers (in each of two generations).
REMEMBERED = 400_000
#: Bytes of text encoded in one pass.
PASS = 1 << 22
#: Longer words are compared in windows; words open after so many rounds are finished by a queue.
WINDOW_FROM, ROUNDS = 64, 256
NONE = np.int32(2**31 - 1)


class PieceModel:
    """Vocabulary and merges of a model file: byte pairs, byte fallback, text not normalised,
    a blank set before it."""

    _loaded: dict[str, "PieceModel"] = {}

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        of = {pieces[i]: i for i in plain}
        fallback = {int(pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(fallback) < 256 or model.normalize("Ａ  b ") != f"{BLANK}Ａ{BLANK}{BLANK}b{BLANK}":
            raise ValueError("only models with byte fallback that leave the text as it is are supported")
        if any(BLANK in p.lstrip(BLANK) for p in of):
            raise ValueError("pieces with a blank behind another character are not supported")
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.bytes = np.array([fallback[b] for b in range(256)], np.int32)
        self.text = [b"" if model.is_control(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        for b, i in fallback.items():
            self.text[i] = bytes([b])
        self.joined = np.frombuffer(b"".join(self.text), np.uint8)
        self.text_size = np.array(list(map(len, self.text)), np.int64)
        self.text_at = np.cumsum(self.text_size) - self.text_size
        self.longest = max(map(len, of))
        scores, place = np.unique([-model.get_score(i) for i in plain], return_inverse=True)
        rank = np.full(size, NONE, np.int32)
        rank[plain] = place
        self.early = np.zeros(size, bool)
        self.early[plain] = np.bincount(place)[place] > 1
        keys, made = [], []
        for piece, i in of.items():
            for k in range(1, len(piece)):
                a, b = of.get(piece[:k]), of.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(i)
                for part in (a, b):
                    if part is not None and rank[i] <= rank[part]:
                        self.early[part] = True
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]
        self.rank = rank
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)       # a character without a piece: below zero
        for piece, i in of.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.symbol[0x20] = self.symbol[ord(BLANK)]
        self.run = self._run_of_blanks(of)

    @classmethod
    def of(cls, path: str) -> "PieceModel":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _run_of_blanks(self, of: dict[str, int]) -> int:
        """Blanks after which a run of blanks can be cut (0: never): pieces of blanks alone
        merge last, and from the left in pieces of this length."""
        runs = {len(p): i for p, i in of.items() if not p.strip(BLANK)}
        longest = max(runs)
        others = max(int(self.rank[i]) for p, i in of.items() if p.strip(BLANK))
        if longest < 2 or any(p[:2] == BLANK * 2 and p.strip(BLANK) for p in of):
            return 0
        if min(int(self.rank[i]) for n, i in runs.items() if n > 1) <= others:
            return 0
        cut = lambda n: [len(self.text[i]) for i in self.finish([runs[1]] * n)]
        whole = all(cut(n) == [longest, *cut(n - longest)] for n in range(longest + 1, 3 * longest + 1))
        return longest if whole else 0

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE: no piece) and the piece that it makes."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        made = np.where(hit, self.made[at], 0)
        return np.where(hit, self.rank[made], NONE), made

    def finish(self, symbols: list[int]) -> list[int]:
        """The merges of one word from any state on: best rank first, then leftmost."""
        n = len(symbols)
        symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int, int, int]] = []
        table = getattr(self, "_table", None)
        if table is None:
            table = self._table = dict(zip(self.keys.tolist(), self.made.tolist()))
            self._ranks = self.rank.tolist()
        ranks = self._ranks

        def offer(i: int) -> None:
            j = after[i]
            if j < n and symbols[i] >= 0 and symbols[j] >= 0:
                piece = table.get(symbols[i] << 32 | symbols[j])
                if piece is not None:
                    heapq.heappush(queue, (ranks[piece], i, symbols[i], symbols[j], piece))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while queue:
            _, i, a, b, piece = heapq.heappop(queue)
            j = after[i]
            if gone[i] or symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], gone[j], after[i] = piece, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s, g in zip(symbols, gone) if not g]

    def encode(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of words (``word``: number of each symbol's word, ascending) and
        their words."""
        size = np.bincount(word)
        long = (size > WINDOW_FROM)[word]
        out = [self._rounds(symbols[~long], word[~long], False), self._rounds(symbols[long], word[long], True)]
        symbols, word = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _rounds(self, sym: np.ndarray, word: np.ndarray, windows: bool) -> tuple[np.ndarray, np.ndarray]:
        done = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        rank, made = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self.pairs(sym[:-1], sym[1:])
            rank[:-1][word[1:] != word[:-1]] = NONE
        for _ in range(ROUNDS):
            if not len(sym):
                break
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low = np.minimum.reduceat(rank, first)
            held = np.diff(np.append(first, len(sym)))
            over = np.repeat(low == NONE, held)
            if over.any():                                          # words without a pair leave
                done.append((sym[over], word[over]))
                sym, word, rank, made = (x[~over] for x in (sym, word, rank, made))
                low, held = low[low != NONE], held[low != NONE]
                if not len(sym):
                    break
            if windows:
                at = self._window_places(rank, made)
            else:
                at = np.flatnonzero(rank == np.repeat(low, held))
                at = self._word_places(at, word, made)
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            here = at - np.arange(len(at))                          # places after compaction
            sym, word, rank, made = (x[keep] for x in (sym, word, rank, made))
            changed = np.zeros(len(sym) + 1, bool)                  # pairs that hold a new symbol
            changed[here] = changed[here - 1] = True
            look = np.flatnonzero(changed[:-1])
            rank[look] = NONE
            look = look[look + 1 < len(sym)]
            look = look[word[look] == word[look + 1]]
            rank[look], made[look] = self.pairs(sym[look], sym[look + 1])
        if len(sym):                                                # very long words with one repeated pattern
            cuts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1], [True])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                rest = np.array(self.finish(sym[a:b].tolist()), np.int32)
                done.append((rest, np.full(len(rest), word[a])))
        return tuple(np.concatenate(x) for x in zip(*done))

    def _word_places(self, at: np.ndarray, word: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Of the places of each word's best pair: those that don't overlap, from the left;
        the first alone if its piece can bring up an earlier pair."""
        first = np.ones(len(at), bool)
        first[1:] = word[at[1:]] != word[at[:-1]]
        leads = np.flatnonzero(first)
        early = self.early[made[at]]
        alone = np.repeat(np.logical_or.reduceat(early, leads), np.diff(np.append(leads, len(at))))
        return at[np.where(alone, first, _every_other(at))]

    def _window_places(self, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Places whose pair is the best within the length of a piece on either side: of equal
        ones those that don't overlap, or, for pieces that can bring up an earlier pair, one
        with no equal within that length on its left."""
        reach = 2 * self.longest
        before, behind = _least(rank, reach), _least(rank[::-1], reach)[::-1]
        best = (rank < NONE) & (rank <= before) & (rank <= behind)
        early = self.early[made]
        lone = np.flatnonzero(best & early & (rank < before))
        at = np.flatnonzero(best & ~early)
        if len(at):
            lead = np.concatenate(([True], at[1:] != at[:-1] + 1))
            cut = lead & (at > 0) & (rank[at - 1] == rank[at])      # its run begins farther left, not yet settled
            group = np.cumsum(lead) - 1
            at = at[_every_other(at) & ~cut[lead][group]]
        return np.sort(np.concatenate((lone, at)))

    def ids(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of final symbols, characters without a piece as their bytes, and their words."""
        strange = symbols < 0
        if not strange.any():
            return symbols, word
        points = -1 - symbols[strange].astype(np.int64)
        held = np.ones(len(symbols), np.int64)
        held[strange] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        out, raw = np.repeat(symbols, held), points.astype("<u4").tobytes().decode("utf-32-le").encode()
        out[np.repeat(strange, held)] = self.bytes[np.frombuffer(raw, np.uint8)]
        return out, np.repeat(word, held)

    def decode(self, ids) -> bytes:
        """The text of ids as UTF-8, without the space set before it."""
        return b"".join([self.text[i] for i in ids]).removeprefix(b" ")


def _every_other(at: np.ndarray) -> np.ndarray:
    """Marks the first, third, ... of each run of neighbouring places."""
    lead = np.concatenate(([True], at[1:] != at[:-1] + 1))
    count = np.arange(len(at))
    return (count - count[lead][np.cumsum(lead) - 1]) % 2 == 0


def _least(rank: np.ndarray, reach: int) -> np.ndarray:
    """Least of the ``reach`` values before each place."""
    out = np.full(len(rank), NONE, np.int32)
    out[1:] = rank[:-1]
    width = 1
    while width < reach:
        step = min(width, reach - width)
        more = out.copy()
        more[step:] = np.minimum(out[step:], out[:-step])
        out, width = more, width + step
    return out


def _ragged(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of runs of ``size`` from ``at`` on, one after another."""
    stop = np.cumsum(size)
    return np.repeat(at - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)


class _Known:
    """Words by hash, each with a second hash that confirms it, and their ids."""

    def __init__(self) -> None:
        self.keys = self.checks = np.zeros(0, np.uint64)
        self.at = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Index of each word, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[place] == keys) & (self.checks[place] == checks), place, -1)

    def add(self, keys: np.ndarray, checks: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys, kind="stable")
        at = len(self.ids) + np.cumsum(size) - size
        self.keys, self.checks = keys[order], np.concatenate((self.checks, checks))[order]
        self.at, self.size = np.concatenate((self.at, at))[order], np.concatenate((self.size, size))[order]
        self.ids = np.concatenate((self.ids, ids))


class _Memory:
    """A task's memory of words, in two generations."""

    def __init__(self, path: str) -> None:
        self.model = PieceModel.of(path)
        self.recent, self.older = _Known(), _Known()

    def tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        keys, first, which = distinct_words(data, starts, ends)
        checks = _hash_segment(data, starts[first], ends[first], CHECK)
        size, parts, fresh = np.zeros(len(keys), np.int64), [], []
        at, base, open_ = np.zeros(len(keys), np.int64), 0, np.arange(len(keys))
        for known in (self.recent, self.older):
            place = known.find(keys[open_], checks[open_])
            hit, place = open_[place >= 0], place[place >= 0]
            size[hit] = known.size[place]
            at[hit] = base + np.cumsum(size[hit]) - size[hit]
            parts.append(known.ids[_ragged(known.at[place], size[hit])])
            base += len(parts[-1])
            open_ = np.setdiff1d(open_, hit, assume_unique=True)
            if known is self.older:
                fresh.append((hit, parts[-1]))
        if len(open_):
            ids, word = self._encode(data, starts[first[open_]], ends[first[open_]])
            size[open_] = np.bincount(word, minlength=len(open_))
            at[open_] = base + np.cumsum(size[open_]) - size[open_]
            parts.append(ids)
            fresh.append((open_, ids))
        for some, ids in fresh:
            if len(some):
                self.recent.add(keys[some], checks[some], size[some], ids)
        if len(self.recent.keys) > REMEMBERED:
            self.older, self.recent = self.recent, _Known()
        size = size[which]
        return np.concatenate(parts)[_ragged(at[which], size)], size

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data[_ragged(starts, ends - starts)].tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        lead = np.cumsum(width) - width
        word = np.repeat(np.arange(len(starts)), np.diff(np.searchsorted(
            lead, np.concatenate(([0], np.cumsum(ends - starts))))))
        return self.model.ids(*self.model.encode(self.model.symbol[points], word))


def _words_of(column: pa.Array, run: int):
    """Bytes of the texts (a space before each that isn't empty), the places where words
    begin, and the texts' offsets."""
    column = column.fill_null("")
    column = pc.replace_substring(column, BLANK, " ")
    column = pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(" ", column, ""))
    data, offsets = text_buffer(column)
    blank = data == 0x20
    new = blank.copy()
    new[1:] &= ~blank[:-1]
    new[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(new)
    if run and len(starts):
        solid = np.append(np.flatnonzero(~blank), len(data))
        stop = np.minimum(solid[np.searchsorted(solid, starts)], np.append(starts[1:], len(data)))
        more = (stop - starts - 1) // run                           # cuts with a blank left behind them
        if more.any():
            at = np.repeat(starts, more)
            step = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more) + 1
            starts = np.sort(np.concatenate((starts, at + step * run)))
    return data, starts, offsets


def _round_trip(path: str):
    def run(batches):
        memory = _Memory(path)
        model = memory.model
        begin, end = (np.array([i], "<u4").tobytes() for i in (model.begin, model.end))
        for batch in batches:
            n = batch.num_rows
            data, starts, offsets = _words_of(batch.column("text"), model.run)
            ends, firsts = np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)
            total = np.full(n, 2, np.int64)
            ids, back = [hashlib.sha256(begin) for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            first = 0
            while first < len(starts):                              # words of about PASS bytes, whatever their texts
                last = max(int(np.searchsorted(ends, starts[first] + PASS, side="right")), first + 1)
                low, high = int(starts[first]), int(ends[last - 1])
                tokens, size = memory.tokens(data[low:high], starts[first:last] - low, ends[first:last] - low)
                text = model.joined[_ragged(model.text_at[tokens], model.text_size[tokens])]
                cuts = np.concatenate(([0], np.cumsum(size)))
                spread = np.concatenate(([0], np.cumsum(model.text_size[tokens])))[cuts]
                one, two = (int(np.searchsorted(firsts, w, side="right")) - 1 for w in (first, last - 1))
                for row in range(one, two + 1):
                    a, b = (int(min(max(firsts[r], first), last)) - first for r in (row, row + 1))
                    if b > a:
                        begins = int(firsts[row] - first == a)       # the space before the text
                        ids[row].update(tokens[cuts[a]:cuts[b]].astype("<u4"))
                        back[row].update(text[spread[a] + begins:spread[b]])
                        total[row] += cuts[b] - cuts[a]
                first = last
            for h in ids:
                h.update(end)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total), pa.array([h.hexdigest() for h in ids], pa.string()),
                 pa.array([h.hexdigest() for h in back], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs`` (doc_id,
    text; other columns ignored): number and digest of the ids of the whole text, begin
    and end included, and digest of the text that they decode to.  ``path``: a model file,
    on every machine.  Null text is empty (begin and end alone); doc_id may be null or
    repeat; an empty table gives an empty result; texts that look like special pieces are
    ordinary text."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_round_trip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(path: str):
    def run(batches):
        memory = _Memory(path)
        for batch in batches:
            data, starts, offsets = _words_of(batch.column("text"), memory.model.run)
            tokens, size = memory.tokens(data, starts, np.append(starts[1:], len(data)))
            cuts = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(starts, offsets)]
            out = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(tokens, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), out], names=["doc_id", "ids"])
    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row of ``docs``, without begin and end; null text is empty."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_ids(path), "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of ``rows`` (doc_id, ids); null ids give null."""
    def run(batches):
        model = PieceModel.of(path)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids).decode("utf-8", "replace")
                     for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
