"""Secret scanning: fixed patterns, and a linear-chain conditional random field.

The patterns give exact base spans.  The field tags every token as secret-begin,
inside or outside from its shape, how far its letters are from the corpus's words,
its neighbouring words and features of the whole file, and is decoded by Viterbi.
All tokens are scored; decoding leaves out only those whose scores prove that the
best path has them outside (``Field.runs``).  The field is trained
on all documents, with the tags that the patterns give.  Every secret is learned
from with the tokens around it: part of these runs hide the keyword and the
neighbours, and part have the value respelled in other characters, so that shape
counts by itself.  Against them stand all other tokens of the corpus, counted by
their features, and in texts that hold a secret also numbers and signs with their
neighbours.  The likelihood and its gradient are summed up by Spark, by slices of the
features; the driver gets the sums alone, and has the vectors of the search on disk.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import cached_property
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.shared import code_points, release, released, stored, tune
from tillroll.llm.textkit import _hash_segment
from tillroll.llm.weights import Features, Weights, feature_keys, fill, hashes, on_disk

#: Steps of training, its penalty on squared weights (times the root of the runs with a secret), the
#: least share of all training weight that a feature must occur in, runs to a task.
STEPS, PENALTY, RARE, TASK_RUNS = 30, 0.45, 1e-6, 50_000
#: Features whose slopes travel in one cell, and whose slopes are added up in one task.
SLICE, TASK_FEATURES = 1 << 11, 1 << 17
#: Weight of all other tokens, against 1 of all runs with a secret: those counted by their features,
#: odd (not of letters, over 3 long) and others, and odd ones with their neighbours.
AGAINST = {"odd": 0.003, "even": 0.3, "near": 0.0003}
#: Parts the features of a token (white space, so in none); characters of text counted at once
#: (few, as a worker keeps what its arrays took).
SEPARATOR, COUNTED = "\x1f", 1 << 18

# The patterns, and the least length of what they must match.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16}
KEYWORDS = r"(?i)password|passwd|secret|token|api_?key"

#: Word characters, joined by signs that passwords and addresses hold; or other signs.
TOKEN = re.compile(r"[\w+/\-]+(?:[.!@#$%^&*~?]+[\w+/\-]+)*|[^\s\w+/\-]+")
_KEYWORD = re.compile(KEYWORDS)
_DENSE = re.compile(r"[A-Za-z0-9_+/.\-]{8,}")
_DIGIT = re.compile(r"[0-9]")
_LETTERS = re.compile(r"[^\W\d_]+")
OUT, BEGIN, INSIDE = 0, 1, 2
#: Features that a token doesn't have by itself, and the one it has where they are hidden.
AROUND = ("before1=", "before2=", "before3=", "after=", "named=", "keys=", "rows=", "code=", "dense=")
UNNAMED = "named=False"
#: Tokens whose scores are remembered in a worker (in each of two generations), and
#: characters of text whose tokens are scored at once.
REMEMBERED, PREPARED = 1 << 18, 1 << 18
#: Alphabets of respelled values.
_az = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (_az, _az + _az.upper(), "0123456789abcdef", _az + "0123456789", _az + _az.upper() + "0123456789+/",
             _az + _az.upper() + "0123456789!@#$%&*?")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) of the fixed patterns, in code points."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the secrets in the base spans, without their keywords."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    return out + [(a, b) for a, b, k in base_spans(text) if k]


def _class(c: str) -> str:
    if c.isdigit():
        return "9"
    if c.isalpha():
        return "A" if c.isupper() else "x" if c in "abcdef" else "a"
    return c if c in "-/." else {"_": "-", "+": "/"}.get(c, "!")


_CLASS = {k: _class(chr(k)) for k in range(0x250)}


_LETTER = {c: k for k, c in enumerate(_az)}
#: Of code points up to 0x250 (which stands for all others): 1 for capitals, 2 for letters, 4 for
#: a to f, 0 for what isn't a letter or has no lower case of one sign; and the letter's number.
_POINT_KIND = np.array([{"A": 1, "a": 2, "x": 4}.get(_class(chr(k)), 0) * (chr(k).isalpha() and len(chr(k).lower()) == 1)
                        for k in range(0x250)] + [0], np.int64)
_POINT_LETTER = np.array([_LETTER.get(chr(k).lower(), 26) for k in range(0x251)], np.int64)
_IS_LETTER = np.array([chr(k).isalpha() for k in range(0x251)])


#: Kinds of code points up to 0x250 in tokens: white space, word characters, signs that join
#: words, other signs; and what dense keys are made of.
SPACE, WORD, JOINER, SIGN = range(4)


def _kind(c: str) -> int:
    return SPACE if c.isspace() else WORD if re.match(r"[\w+/\-]", c) else JOINER if c in ".!@#$%^&*~?" else SIGN


_KIND = np.array([_kind(chr(k)) for k in range(0x250)], np.uint8)
_KEY = np.array([bool(re.match(r"[A-Za-z0-9_+/.\-]", chr(k))) for k in range(0x250)] + [False])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def token_bounds(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every match of ``TOKEN``, and whether white space follows: runs of
    one kind, where signs that all join, between word characters, don't part them."""
    kind = _KIND[np.minimum(points, len(_KIND) - 1)]
    rare = np.flatnonzero(points >= len(_KIND))
    if len(rare):
        which, at = np.unique(points[rare], return_inverse=True)
        kind[rare] = np.array([_kind(chr(c)) for c in which.tolist()], np.uint8)[at]
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    run = np.minimum(kind, JOINER)
    start = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    run, most = run[start], np.maximum.reduceat(kind, start)
    word = np.concatenate(([False], run == WORD, [False]))
    joins = (run == JOINER) & (most == JOINER) & word[:-2] & word[2:]
    joined = joins | (run == WORD) & np.concatenate(([False], joins[:-1]))
    head = np.flatnonzero(~joined)
    token = run[head] != SPACE
    end = np.append(start[head[1:]], len(points))[token]
    start = start[head][token]
    return start, end, kind[np.minimum(end, len(kind) - 1)] == SPACE


def _letters(points: np.ndarray) -> np.ndarray:
    """Numbers of the letters (a to z in either case, 26 for any other), -1 for other signs."""
    ids = _POINT_LETTER[np.minimum(points, len(_POINT_LETTER) - 1)]
    ids[~_IS_LETTER[np.minimum(points, len(_IS_LETTER) - 1)]] = -1
    rare = np.flatnonzero(points >= len(_POINT_LETTER) - 1)
    if len(rare):
        which, at = np.unique(points[rare], return_inverse=True)
        ids[rare] = np.array([_LETTER.get(chr(c).lower(), 26) if chr(c).isalpha() else -1 for c in which.tolist()])[at]
    return ids


def pair_counts(texts: list[str], suspects: list[bool], counts: np.ndarray) -> None:
    """Adds the neighbouring letters of the words of ``texts`` to 27 x 27 ``counts``
    (a to z, any other letter); secrets of base spans are left out."""
    points = _points("\n".join(texts))
    ids = _letters(points)
    ids[_in_values(texts, suspects, len(points))] = -1
    both = (ids[:-1] >= 0) & (ids[1:] >= 0)
    counts += np.bincount(ids[:-1][both] * 27 + ids[1:][both], minlength=729).reshape(27, 27)


def _in_values(texts: list[str], suspects: list[bool], size: int) -> np.ndarray:
    """Which points of the joined texts are in a secret of a base span."""
    step, first = np.zeros(size + 1, np.int64), 0
    for text, maybe in zip(texts, suspects):
        for a, b in values(text) if maybe else ():
            step[first + a] += 1
            step[first + b] -= 1
        first += len(text) + 1
    return np.cumsum(step[:-1]) > 0


def _clogc(count: int) -> float:
    return count * math.log2(count)


def own_features(token: str, pairs: list[list[float]]) -> list[str]:
    """Features of the token alone; ``pairs`` are log odds of neighbouring letters
    in words against letters at random."""
    kinds = token.translate(_CLASS) if token.isascii() else "".join(map(_class, token))
    classes = "".join(sorted(set(kinds)))
    squeezed = "".join(k for k, _ in groupby(kinds.replace("x", "a")))
    n = len(token)
    bits = math.log2(n) - math.fsum(_clogc(token.count(c)) for c in set(token)) / n
    odds = steps = 0
    for word in _LETTERS.findall(token.lower()) if len(squeezed) > 1 or not kinds.islower() else [token]:
        ids = [_LETTER.get(c, 26) for c in word]
        odds += sum([pairs[i][j] for i, j in zip(ids, ids[1:])])
        steps += len(ids) - 1
    like = f"words={max(-8, min(8, int(odds // 3)))}"
    mean = int(2 * odds / steps) if steps else "none"
    return [f"set={classes}", f"long={min(n // 4, 12)}", f"shape={squeezed[:12]}",
            f"start={token[:4] if token[:4].isalpha() and token[:4].isupper() else ''}", f"bits={int(2 * max(bits, 0) + 1e-12)}",
            f"flips={min(len(squeezed) - 1, 10)}", f"set={classes} long={min(n // 8, 6)}",
            like, f"mean={mean} long={min(n // 8, 4)}", f"sign={token[:4] if not kinds.strip('!') else ''}"]


def word_codes(points: np.ndarray, start: np.ndarray, end: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the tokens of ``points`` are words (letters, all but the first of lower case),
    and of those alone, a column each, what their own features are made of: kinds of letters,
    length (in fours, in eights), bits, log odds, mean odds (0 for none, else 100 more)."""
    size = end - start
    if not len(size):
        return np.zeros(0, bool), np.zeros((6, 0), np.int64)
    first = np.cumsum(size) - size
    points = np.minimum(points[np.arange(size.sum()) + np.repeat(start - first, size)], len(_POINT_KIND) - 1)
    kind, lead = _POINT_KIND[points], np.zeros(len(points), bool)
    lead[first] = True
    word = ~np.logical_or.reduceat((kind == 0) | (kind == 1) & ~lead, first) & ((size > 1) | (kind[first] != 1))
    keep = np.repeat(word, size)
    points, kind, size = points[keep], kind[keep], size[word]
    n = len(size)
    if not n:
        return word, np.zeros((6, 0), np.int64)
    first, owner = np.cumsum(size) - size, np.repeat(np.arange(n), size)
    mask = np.bitwise_or.reduceat(kind, first)
    # bits of a letter: from how often each occurs in its word
    key = np.sort(owner << 12 | points)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    held = np.diff(np.append(new, len(key)))
    bits = np.log2(size) - np.bincount(key[new] >> 12, held * np.log2(held), n) / size
    bits = np.minimum((2 * np.maximum(bits, 0) + 1e-12).astype(np.int64), 63)
    # log odds of neighbouring letters
    letter, inner = _POINT_LETTER[points], np.ones(len(points), bool)
    inner[first] = False
    right = np.flatnonzero(inner)
    odds = np.bincount(owner[right], pairs[letter[right - 1], letter[right]], n)
    steps = size - 1
    mean = np.where(steps > 0, np.clip((2 * odds / np.maximum(steps, 1)).astype(np.int64), -99, 99) + 100, 0)
    return word, np.array([mask, np.minimum(size // 4, 12), np.minimum(size // 8, 6), bits,
                           np.clip(odds // 3, -8, 8).astype(np.int64), mean])


def word_features(mask: int, fours: int, eights: int, bits: int, odds: int, mean: int) -> list[str]:
    """``own_features`` of a word with these ``word_codes``."""
    classes = "".join(k for k, bit in zip("Aax", (1, 2, 4)) if mask & bit)
    return [f"set={classes}", f"long={fours}", f"shape={'Aa' if mask & 1 else 'a'}", "start=", f"bits={bits}",
            f"flips={mask & 1}", f"set={classes} long={eights}", f"words={odds}",
            f"mean={mean - 100 if mean else 'none'} long={min(eights, 4)}", "sign="]


def file_features(text: str) -> list[str]:
    spans = [m.span() for m in _DENSE.finditer(text) if _DIGIT.search(m[0])]
    return [f"keys={min(len(spans), 5)}", f"rows={min((text.count(chr(10)) + 1).bit_length(), 6)}",
            f"code={'{' in text or ';' in text}", f"dense={int(10 * sum(b - a for a, b in spans) / len(text))}"]


def _neighbour(token: str) -> str:
    """How a token is named as a neighbour: a word or signs as such, others alike."""
    return token[:16].lower() if token.isalpha() else "9" if _DIGIT.search(token) else token[:4]


class Tokens:
    """The chain of a text: every token, and its features on demand."""

    def __init__(self, text: str, pairs: list[list[float]]):
        self.text, self.pairs = text, pairs
        self.spans = [m.span() for m in TOKEN.finditer(text)]
        self.words = [text[a:b] for a, b in self.spans]
        self.file: list[str] | None = None

    def features(self, k: int) -> list[str]:
        if self.file is None:
            self.file = file_features(self.text)
        words, n = self.words, len(self.words)
        out = own_features(words[k], self.pairs)
        for i in (1, 2, 3):
            out.append(f"before{i}={_neighbour(words[k - i]) if k >= i else '<'}")
        a, b = self.spans[k]
        out.append(f"after={_neighbour(words[k + 1]) if k + 1 < n else '>'}")
        out.append(f"named={any(_KEYWORD.search(w) for w in words[max(0, k - 4):k + 1])}")
        left = k > 0 and self.spans[k - 1][1] == a
        right = k + 1 < n and self.spans[k + 1][0] == b
        out.append(f"glued={left:d}{right:d}")
        return out + self.file

    def run(self, first: int, last: int) -> list[tuple]:
        return [(*self.spans[k], self.features(k)) for k in range(first, last)]


class _Memory:
    """Scores of tokens by hash; a second hash in the row's check tells apart what the
    first confuses."""

    def __init__(self):
        self.place: dict[int, int] = {}
        self.checks, self.rows, self.held = np.zeros(1024, np.uint64), np.zeros((1024, 11)), 0

    def __len__(self):
        return self.held

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        row = np.fromiter(map(self.place.get, keys.tolist(), repeat(-1)), np.int64, len(keys))
        return np.where((row >= 0) & (self.checks[row] == checks), row, -1)

    def add(self, keys: np.ndarray, checks: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Adds tokens (a key that is there goes to the new one); their rows."""
        need = self.held + len(keys)
        if need > len(self.rows):
            room = max(need, 2 * len(self.rows)) - len(self.rows)
            self.rows = np.concatenate((self.rows, np.zeros((room, 11))))
            self.checks = np.concatenate((self.checks, np.zeros(room, np.uint64)))
        own = np.arange(self.held, need)
        self.rows[own], self.checks[own], self.held = rows, checks, need
        self.place.update(zip(keys.tolist(), own.tolist()))
        return own


class Field:
    """Linear-chain CRF over tags outside, begin, inside (inside only follows
    begin or inside; before a run all is outside)."""

    def __init__(self, weights: Weights | dict[str, np.ndarray] | None = None, moves: np.ndarray | None = None,
                 pairs: np.ndarray | None = None):
        self.weights = weights if isinstance(weights, Weights) else Weights.named(weights or {})
        self.moves = np.zeros((3, 3)) if moves is None else moves
        self.pairs = np.zeros((27, 27)).tolist() if pairs is None else pairs.tolist()
        self._forget()

    def __reduce__(self):
        return Field, (self.weights, self.moves, np.array(self.pairs))

    def _forget(self) -> None:
        """Scores of tokens, in two generations (rows: gains over outside of begin and
        inside, of the token itself, as first to third neighbour before and as the one after;
        whether it holds a keyword)."""
        self._recent, self._older = _Memory(), _Memory()
        self._files: dict[tuple, np.ndarray] = {}
        self._known: dict[str, int] = {}
        whole = lambda names: self.weights.table[self._rows(list(names))]
        sets = ["".join(k for k, bit in zip("Aax", (1, 2, 4)) if m & bit) for m in range(8)]
        self._tables = {
            "set": whole(f"set={x}" for x in sets), "long": whole(f"long={k}" for k in range(13)),
            "shape": whole(("shape=a", "shape=Aa")), "start": whole(("start=",)), "bits": whole(f"bits={k}" for k in range(64)),
            "flips": whole(("flips=0", "flips=1")), "set long": whole(f"set={x} long={k}" for x in sets for k in range(7)),
            "words": whole(f"words={k}" for k in range(-8, 9)),
            "mean": whole(f"mean={m} long={k}" for m in ("none", *range(-99, 100)) for k in range(5)),
            "sign": whole(("sign=",))}
        self._before = [self._gain([f"before{i}=<"]) for i in (1, 2, 3)]
        self._last = self._gain(["after=>"])
        self._named = np.array([self._gain(["named=False"]), self._gain(["named=True"])])
        self._glued = np.array([self._gain([f"glued={g}"]) for g in ("00", "01", "10", "11")])

    def _rows(self, features: list[str]) -> np.ndarray:
        """Rows of the features in the table of weights, remembered or sought together."""
        new = [f for f in dict.fromkeys(features) if f not in self._known]
        if len(self._known) + len(new) > REMEMBERED:
            self._known.clear()
            new = list(dict.fromkeys(features))
        if new:
            self._known.update(zip(new, self.weights.rows(new).tolist()))
        return np.fromiter(map(self._known.__getitem__, features), np.int64, len(features))

    def _gain(self, features: list[str]) -> np.ndarray:
        out = self.weights.table[self._rows(features)].sum(0)
        return out[1:] - out[OUT]

    @cached_property
    def _near(self) -> tuple[Features, np.ndarray]:
        return self.weights.neighbours()

    def _word_gains(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own gains of many tokens at once, and which of them are words (letters, all but the
        first of lower case): of those alone."""
        word, codes = word_codes(points, start, end, np.array(self.pairs))
        out, t = np.zeros((len(word), 2)), self._tables
        mask, fours, eights, bits, odds, mean = codes
        capital = mask & 1
        total = (t["set"][mask] + t["long"][fours] + t["shape"][capital] + t["start"][0] + t["bits"][bits]
                 + t["flips"][capital] + t["set long"][7 * mask + eights] + t["words"][odds + 8]
                 + t["mean"][5 * mean + np.minimum(eights, 4)] + t["sign"][0])
        out[word] = total[:, 1:] - total[:, :1]
        return out, word

    def _new_rows(self, text: str, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        tokens = [text[a:b] for a, b in zip(start.tolist(), end.tolist())]
        rows = np.zeros((len(tokens), 11))
        rows[:, :2], word = self._word_gains(points, start, end)
        names = [x[:16].lower() for x in tokens]                 # of words; of others below
        others = np.flatnonzero(~word)
        if len(others):
            own = [own_features(tokens[i], self.pairs) for i in others.tolist()]
            total = np.add.reduceat(self.weights.table[self._rows([f for x in own for f in x])],
                                    np.cumsum([0] + [len(x) for x in own[:-1]]))
            rows[others, :2] = total[:, 1:] - total[:, :1]
            for i in others.tolist():
                names[i] = _neighbour(tokens[i])
        near, gains = self._near
        rows[:, 2:10] = gains[near.at(*hashes(pa.array(names, pa.string())))]
        starts = np.cumsum([0] + [len(x) + 1 for x in tokens])
        for m in _KEYWORD.finditer("\n".join(tokens)):
            rows[int(np.searchsorted(starts, m.start(), side="right")) - 1, 10] = 1
        return rows

    def _scores(self, text: str, points: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Rows of the distinct tokens, remembered or new, and for each token which of them it is."""
        data = points.view(np.uint8)
        keys, first, which = np.unique(_hash_segment(data, 4 * start, 4 * end), return_index=True, return_inverse=True)
        checks = _hash_segment(data, 4 * start[first], 4 * end[first], 1)
        if len(self._recent) > REMEMBERED:
            self._older, self._recent = self._recent, _Memory()
        at = self._recent.find(keys, checks)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            old = self._older.find(keys[fresh], checks[fresh])
            rows = np.zeros((len(fresh), 11))
            rows[old >= 0] = self._older.rows[old[old >= 0]]
            new = fresh[old < 0]
            if len(new):
                rows[old < 0] = self._new_rows(text, points, start[first[new]], end[first[new]])
            at[fresh] = self._recent.add(keys[fresh], checks[fresh], rows)
        return self._recent.rows[at], which

    def _file_gains(self, points: np.ndarray, edges: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Gains of ``file_features`` of the texts that start at ``edges``."""
        key = np.concatenate(([False], _KEY[np.minimum(points, len(_KEY) - 1)], [False]))
        runs = np.flatnonzero(key[1:] != key[:-1]).reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] >= 8]
        digits = np.concatenate(([0], np.cumsum((points >= 48) & (points <= 57))))
        runs = runs[digits[runs[:, 1]] > digits[runs[:, 0]]]
        owner = np.searchsorted(edges, runs[:, 0], side="right") - 1
        n = len(edges)
        keys = np.bincount(owner, minlength=n)
        dense = 10 * np.bincount(owner, runs[:, 1] - runs[:, 0], n).astype(np.int64) // np.maximum(sizes, 1)

        def held(hit):
            total = np.concatenate(([0], np.cumsum(hit)))
            return total[edges + sizes] - total[edges]
        out = np.zeros((n, 2))
        for i, f in enumerate(zip(keys.tolist(), held(points == 10).tolist(),
                                  (held((points == 123) | (points == 59)) > 0).tolist(), dense.tolist())):
            f = (min(f[0], 5), min((f[1] + 1).bit_length(), 6), *f[2:])
            if f not in self._files:
                self._files[f] = self._gain([f"keys={f[0]}", f"rows={f[1]}", f"code={f[2]}", f"dense={f[3]}"])
            out[i] = self._files[f]
        return out

    def prepare(self, texts: list[str]) -> list[np.ndarray]:
        """``gains`` of every text, worked out over all their tokens at once."""
        _, _, _, cuts, out = self._prepared(texts)
        return [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _prepared(self, texts: list[str]):
        """Of all texts joined: start and end of every token, where each text begins, the first
        token of each text (and their number), and ``gains`` of all tokens."""
        text = "\n".join(texts)
        points = _points(text)
        start, end, spaced = token_bounds(points)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.cumsum(sizes + 1) - sizes - 1
        cuts = np.append(np.searchsorted(start, edges), len(start))
        n = len(start)
        if not n:
            return start, end, edges, cuts, np.zeros((0, 2))
        rows, which = self._scores(text, points, start, end)
        owner = np.repeat(np.arange(len(texts)), np.diff(cuts))
        place = np.arange(n) - cuts[owner]
        # begin and inside as the two parts of one number; past the last row stands what an edge gains
        pairs = np.zeros((len(rows) + 1, 10))
        pairs[:-1] = rows[:, :10]
        pairs[-1, 2:] = np.concatenate((*self._before, self._last))
        pairs, edge = np.ascontiguousarray(pairs.view(complex).T), len(rows)
        out = pairs[0][which] + self._file_gains(points, edges, sizes).view(complex).ravel()[owner]
        key = rows[:, 10][which] > 0
        named = key.copy()
        for i in (1, 2, 3, 4):
            inside, rest = place >= i, max(0, n - i)
            if i < 4:
                at = np.full(n, edge)
                at[i:] = which[:rest]
                at[~inside] = edge
                out += pairs[i][at]
            if i == 3:
                same = owner[1:] == owner[:-1]
                out += pairs[4][np.append(np.where(same, which[1:], edge), edge)]
            named[i:] |= key[:rest] & inside[i:]
        out += self._named.view(complex).ravel()[named.astype(int)]
        joined = same & ~spaced[:-1]
        glue = np.zeros(n, int)
        glue[1:] += 2 * joined
        glue[:-1] += joined
        return start, end, edges, cuts, (out + self._glued.view(complex).ravel()[glue]).view(float).reshape(n, 2)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(start, end) of the runs tagged begin and inside, in code points of each text: the
        runs of ``maybe`` of all texts decoded together."""
        start, end, edges, cuts, gains = self._prepared(texts)
        runs = [(a + x, a + y) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) for x, y in self.maybe(gains[a:b])]
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not runs:
            return out
        tags = np.zeros(len(start) + 1, np.int8)
        self._decode_all(gains, np.array(runs), tags)
        begin, other = np.flatnonzero(tags == BEGIN), np.flatnonzero(tags != INSIDE)
        last = other[np.searchsorted(other, begin, side="right")] - 1
        owner = np.searchsorted(cuts, begin, side="right") - 1
        for k, a, b in zip(owner.tolist(), (start[begin] - edges[owner]).tolist(), (end[last] - edges[owner]).tolist()):
            out[k].append((a, b))
        return out

    def _decode_all(self, gains: np.ndarray, runs: np.ndarray, tags: np.ndarray) -> None:
        """Writes the best tags (as ``best`` finds them) of the runs (first token, end) into
        ``tags``: a step of Viterbi is taken in all runs that are long enough at once."""
        length = runs[:, 1] - runs[:, 0]
        order = np.argsort(-length, kind="stable")
        first, length = runs[order, 0], length[order]
        more = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")      # runs with an i-th token
        steps, e = self._steps(), np.concatenate((np.zeros((len(gains), 1)), gains), 1)
        score, backs = steps[OUT] + e[first], []
        best = np.zeros(len(first), np.int8)
        for i in range(1, int(length[0])):
            n = int(more[i])
            best[n:len(score)] = score[n:].argmax(1)
            paths = score[:n, :, None] + steps
            backs.append(paths.argmax(1).astype(np.int8))
            score = paths.max(1) + e[first[:n] + i]
        best[:len(score)] = score.argmax(1)
        tags[first + length - 1] = best
        for i in range(int(length[0]) - 1, 0, -1):
            n = int(more[i])
            at = first[:n] + i
            tags[at - 1] = backs[i - 1][np.arange(n), tags[at]]

    def gains(self, text: str, prepared: np.ndarray | None = None) -> np.ndarray:
        """Emissions of begin and inside less that of outside, for every token."""
        return self.prepare([text])[0] if prepared is None else prepared

    def runs(self, text: str, prepared: np.ndarray | None = None) -> list[list[tuple]]:
        """The runs of ``maybe`` with the features of their tokens."""
        edges = self.maybe(self.gains(text, prepared))
        if not edges:
            return []
        chain = Tokens(text, self.pairs)
        return [chain.run(a, b) for a, b in edges]

    def maybe(self, gains: np.ndarray) -> list[tuple[int, int]]:
        """First token and end of the runs of tokens that may be in a span; every other
        token is outside in the best path of the whole chain.

        Setting a span outside loses at most the gains of its tokens, with the best
        move into each, and of leaving it.  So a token can be in a span only if
        some interval that holds it has gains that make up for that.  A run ends
        with the outside token after it, so that leaving counts.
        """
        steps = self._steps() - self.moves[OUT, OUT]
        gains = (gains + steps[:, 1:].max(0)).max(1)
        floor = -max(0.0, float(steps[1:, OUT].max())) - 1e-9
        if not len(gains) or gains.max() < floor:
            return []
        total = np.concatenate([[0.0], np.cumsum(gains)])
        ending = total[1:] - np.minimum.accumulate(total)[:-1]
        starting = np.maximum.accumulate(total[::-1])[::-1][1:] - total[:-1]
        maybe = np.concatenate([[False], ending + starting - gains >= floor, [False]])
        edges = np.flatnonzero(maybe[1:] != maybe[:-1]).reshape(-1, 2).tolist()
        return [(a, min(b + 1, len(gains))) for a, b in edges]

    def emissions(self, run) -> np.ndarray:
        rows = self._rows([f for _, _, features in run for f in features])
        owner = np.repeat(np.arange(len(run)), [len(features) for _, _, features in run])
        return np.stack([np.bincount(owner, w, len(run)) for w in self.weights.table[rows].T], 1)

    def _steps(self) -> np.ndarray:
        steps = self.moves.copy()
        steps[OUT, INSIDE] = -np.inf
        return steps

    def decode(self, run) -> list[int]:
        """Best tags of a run."""
        return self.best(self.emissions(run))

    def best(self, e: np.ndarray) -> list[int]:
        """Best tags by the emissions of a run (Viterbi); ties go to outside."""
        steps = self._steps()
        score, back = steps[OUT] + e[0], []
        for i in range(1, len(e)):
            paths = score[:, None] + steps
            back.append(paths.argmax(0))
            score = paths.max(0) + e[i]
        tags = [int(score.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def _tags(chain: Tokens, secret: list[tuple[int, int]]) -> list[int]:
    """Tags of a chain whose secrets are the spans ``secret``."""
    out, at, held, last = [], 0, sorted(secret), None
    for a, b in chain.spans:
        while at < len(held) and held[at][1] <= a:
            at += 1
        now = held[at] if at < len(held) and held[at][0] < b else None
        out.append(OUT if now is None else INSIDE if last is not None and last[1] > now[0] else BEGIN)
        last = now
    return out


def _hidden(features: list[str]) -> list[str]:
    return [*(f for f in features if not f.startswith(AROUND)), UNNAMED]


def tagged_runs(text: str, pairs: list[list[float]]):
    """Runs (tags, features) of a text that holds secrets, with the tags that the fixed
    patterns give.  Each secret comes with the tokens around it: as it is, with
    keyword and neighbours hidden, and respelled, both ways; and each other token with
    digits or signs with the tokens around it, if none of them is in a secret."""
    secret = sorted(set(values(text)))
    if not secret:
        return
    rng = np.random.default_rng(list(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8]))
    chain = Tokens(text, pairs)
    chain.file = file_features(text)
    tags = _tags(chain, secret)
    starts, ends = zip(*chain.spans)
    heads, longest = [a for a, _ in secret], max(b - a for a, b in secret)

    def around(c, t, first, last):
        at = range(max(0, first - 2), min(len(t), last + 2))
        return [t[k] for k in at], [c.features(k) for k in at]

    for a, b in secret:
        got = [around(chain, tags, bisect_right(ends, a), bisect_left(starts, b))]
        close = secret[bisect_left(heads, a - 120 - longest):bisect_left(heads, b + 60)]
        alone = not any(e > a - 120 and not (s < b and e > a) for s, e in close)
        for letters in ALPHABETS if alone else ():
            new = "".join(rng.choice(list(letters), rng.integers(10, 33)))
            head, tail = text[max(0, a - 120):a], text[b:b + 60]
            other = Tokens(head + new + tail, pairs)
            other.file = chain.file
            t = _tags(other, [(len(head), len(head) + len(new))])
            at = [k for k, x in enumerate(t) if x]
            got.append(around(other, t, at[0], at[-1] + 1))
        for t, f in got:
            yield t, f
            yield t, [_hidden(x) for x in f]
    for k, tag in enumerate(tags):
        if not tag and _odd(chain.words[k]):
            t, f = around(chain, tags, k, k + 1)
            if not any(t):
                yield t, f


def _odd(token: str) -> bool:
    return len(token) > 3 and not token.isalpha()


def _plain(texts: list[str], suspects: list[bool]):
    """The joined texts, their points, and of all tokens that are in no secret of a base span, equal
    ones once: start, end, how they are glued (as a number), count."""
    text = "\n".join(texts)
    points = _points(text)
    start, end, spaced = token_bounds(points)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    edges = np.cumsum(sizes + 1) - sizes - 1
    owner = np.searchsorted(edges, start, side="right") - 1
    joined = (owner[1:] == owner[:-1]) & ~spaced[:-1]
    code = np.zeros(len(start), np.int64)
    code[1:] += 2 * joined
    code[:-1] += joined
    if any(suspects):
        inside = np.concatenate(([0], np.cumsum(_in_values(texts, suspects, len(points)))))
        keep = inside[end] == inside[start]
        start, end, code = start[keep], end[keep], code[keep]
    key = _hash_segment(points.view(np.uint8), 4 * start, 4 * end) ^ (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return text, points, start[first], end[first], code[first], count


def _glue(code: int) -> str:
    return f"glued={code >> 1}{code & 1}"


def plain_tokens(texts: list[str], suspects: list[bool]):
    """(token, how it is glued, count) of all tokens of ``texts`` that are in no secret of
    a base span."""
    text, _, *columns = _plain(texts, suspects)
    for a, b, c, n in zip(*(x.tolist() for x in columns)):
        yield text[a:b], _glue(c), n


def plain_words(texts: list[str], suspects: list[bool], pairs: np.ndarray):
    """``plain_tokens`` in two parts: for words, (``word_codes``, how they are glued) and counts, as columns;
    all others as there."""
    text, points, start, end, code, count = _plain(texts, suspects)
    word, codes = word_codes(points, start, end, pairs)
    # one number for all codes of a word
    mask, fours, eights, bits, odds, mean = codes
    key = mean
    for part, size in ((mask, 8), (fours, 13), (eights, 7), (bits, 64), (odds + 8, 17), (code[word], 4)):
        key = key * size + part
    key, first, at = np.unique(key, return_index=True, return_inverse=True)
    held = np.bincount(at, count[word], len(key)).astype(np.int64)
    words = zip(zip(*codes[:, first].tolist(), code[word][first].tolist()), held.tolist())
    rest = (x[~word].tolist() for x in (start, end, code, count))
    return words, ((text[a:b], _glue(c), n) for a, b, c, n in zip(*rest))


def all_spans(text: str, field: Field, patterns: bool = True,
              found: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """Base spans (none if not ``patterns``) and the runs that the field tags, unless
    a base span holds them.  ``found``: ``Field.spans`` of the text, if known."""
    spans = base_spans(text) if patterns else []
    base = list(spans)
    if not field.weights:
        return spans
    if found is None:
        found = field.spans([text])[0]
    spans += [(a, b, 3) for a, b in found if not any(s <= a and b <= e for s, e, _ in base)]
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def _pieces(column: pa.Array, size: int):
    """The texts of ``column`` and whether a pattern can occur in them, in pieces of about
    ``size`` characters."""
    suspects, texts, first = _suspects(column), column.fill_null("").to_pylist(), 0
    while first < len(texts):
        last, held = first, 0
        while last < len(texts) and (last == first or held + len(texts[last]) <= size):
            held, last = held + len(texts[last]), last + 1
        yield texts[first:last], suspects[first:last]
        first = last


def _spans_of(column: pa.Array, field: Field):
    """Spans of each row, the tokens of about ``PREPARED`` characters of text scored and decoded at once."""
    for texts, suspects in _pieces(column, PREPARED):
        found = field.spans(texts) if field.weights else [[] for _ in texts]
        for text, patterns, own in zip(texts, suspects, found):
            yield all_spans(text, field, patterns, own)


def _suspects(column: pa.Array) -> list[bool]:
    """Whether a pattern can occur in a row at all."""
    match = pc.match_substring_regex(column, r"AKIA|[0-9a-f]{32}|" + KEYWORDS)
    return match.fill_null(False).to_pylist()


def _pair_counts(batches):
    counts = np.zeros((27, 27), np.int64)
    for batch in batches:
        for texts, suspects in _pieces(batch.column("text"), COUNTED):
            pair_counts(texts, suspects, counts)
    yield pa.RecordBatch.from_arrays([pa.array(range(729), pa.int32()), pa.array(counts.ravel())], names=["pair", "n"])


def _secret_runs(pairs):
    def run(batches):
        for batch in batches:
            rows = [r for texts, suspects in _pieces(batch.column("text"), COUNTED)
                    for text, maybe in zip(texts, suspects) if maybe for r in tagged_runs(text, pairs)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in rows], pa.list_(pa.int32())),
                 pa.array([[SEPARATOR.join(x) for x in f] for _, f in rows], pa.list_(pa.string())),
                 pa.array(["secret" if any(t) else "near" for t, _ in rows], pa.string()),
                 pa.array(np.ones(len(rows), np.int64))], names=["tags", "features", "kind", "n"])
    return run


def _plain_counts(pairs):
    table_of_pairs = np.array(pairs)

    def table(total):
        return pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in total], pa.string()), pa.array([k for _, k in total], pa.string()),
             pa.array(list(total.values()), pa.int64())], names=["features", "kind", "n"])

    def run(batches):
        known: dict[str, tuple[str, str]] = {}
        words: dict[tuple, str] = {}
        total: Counter = Counter()
        for batch in batches:
            for texts, suspects in _pieces(batch.column("text"), COUNTED):
                alike, others = plain_words(texts, suspects, table_of_pairs)
                for codes, n in alike:
                    own = words.get(codes)
                    if own is None:
                        own = words[codes] = SEPARATOR.join((*word_features(*codes[:-1]), _glue(codes[-1]), UNNAMED))
                    total[own, "even"] += n
                for token, glued, n in others:
                    own = known.get(token)
                    if own is None:
                        own = known[token] = (SEPARATOR.join(own_features(token, pairs)), "odd" if _odd(token) else "even")
                    total[SEPARATOR.join((own[0], glued, UNNAMED)), own[1]] += n
                if len(known) > REMEMBERED:
                    known.clear()
                if len(words) > REMEMBERED:
                    words.clear()
                if len(total) > REMEMBERED:
                    yield table(total)
                    total.clear()
        yield table(total)
    return run


def _hashed(batches):
    for batch in batches:
        parts = [x.tobytes() for x in feature_keys(batch.column("f"))]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=["keys", "checks", "places"])


CODED = {"tags": np.int8, "length": np.int32, "held": np.int32, "ids": np.int32, "own": np.int32, "weight": np.float64}


def _coded(index):
    """Rows of training, those of a batch as one block: its features by number (``own``), and
    what each token has of them (``ids``); the number after the last one, which has no
    weight, is in every token."""
    def run(batches):
        features: Features = index.value
        none = len(features)
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = batch.column("features").flatten()
            names = pc.split_pattern(tokens, SEPARATOR)
            owner = np.repeat(np.arange(len(tokens)), pc.list_value_length(names).to_numpy())
            found = features.find(names.flatten())
            owner, found = owner[found < none], found[found < none]
            first = np.sort(np.unique(owner * none + found, return_index=True)[1])       # no feature twice in a token
            held = np.bincount(owner[first], minlength=len(tokens)) + 1
            ids = np.full(held.sum(), none)
            last = np.zeros(len(ids), bool)
            last[np.cumsum(held) - 1] = True
            ids[~last] = found[first]
            own, ids = np.unique(ids, return_inverse=True)
            parts = {"tags": batch.column("tags").flatten().to_numpy(), "held": held, "ids": ids, "own": own,
                     "length": pc.list_value_length(batch.column("tags")).to_numpy(), "weight": batch.column("weight").to_numpy()}
            yield pa.RecordBatch.from_arrays([pa.array([parts[k].astype(t).tobytes()], pa.binary()) for k, t in CODED.items()],
                                             names=list(CODED))
    return run


def likelihood(tags: np.ndarray, length: np.ndarray, held: np.ndarray, ids: np.ndarray, weight: np.ndarray,
               weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted negative log likelihood of runs (forward-backward) and its gradients by weights
    and moves.  ``length``: tokens of each run; ``tags``, ``held``: tag and number of
    features of each token; ``ids``: those features.  Before and after a run all is outside."""
    steps = moves.copy()
    steps[OUT, INSIDE] = -np.inf
    e = np.add.reduceat(weights[ids], np.cumsum(held) - held)
    off, start = np.zeros((len(tags), 3)), np.cumsum(length) - length
    loss, by_moves, goals = 0.0, np.zeros((3, 3)), np.eye(3)
    for n in np.unique(length).tolist():
        own = np.flatnonzero(length == n)
        at = start[own][:, None] + np.arange(n)
        x, goal, w = e[at], tags[at], weight[own]
        fwd, bwd = np.zeros(x.shape), np.zeros(x.shape)
        fwd[:, 0], bwd[:, -1] = steps[OUT] + x[:, 0], steps[:, OUT]
        for i in range(1, n):
            fwd[:, i] = np.logaddexp.reduce(fwd[:, i - 1, :, None] + steps, 1) + x[:, i]
        for i in range(n - 2, -1, -1):
            bwd[:, i] = np.logaddexp.reduce(steps + (x[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
        total = np.logaddexp.reduce(fwd[:, -1] + steps[:, OUT], 1)
        before = np.concatenate((np.zeros((len(own), 1), goal.dtype), goal[:, :-1]), 1)
        path = np.take_along_axis(x, goal[:, :, None], 2)[:, :, 0] + steps[before, goal]
        loss += float(w @ (total - path.sum(1) - steps[goal[:, -1], OUT]))
        diff = (np.exp(fwd + bwd - total[:, None, None]) - goals[goal]) * w[:, None, None]
        off[at] = diff
        by_moves[OUT] += diff[:, 0].sum(0)
        by_moves[:, OUT] += diff[:, -1].sum(0)
        for i in range(1, n):
            both = np.exp(fwd[:, i - 1, :, None] + steps + (x[:, i] + bwd[:, i])[:, None, :] - total[:, None, None])
            by_moves += np.einsum("r,rab->ab", w, both)
            np.subtract.at(by_moves, (goal[:, i - 1], goal[:, i]), w)
    off = np.repeat(off, held, axis=0)
    return loss, np.stack([np.bincount(ids, off[:, c], len(weights)) for c in range(3)], 1), by_moves


def _gradient(model):
    """Loss and slopes of a task's blocks, as rows of three by the number of the feature, after them
    the moves and the loss: in cells of the rows of a slice that aren't zero."""
    def run(batches):
        x = model.value
        total = np.zeros((len(x) + 1, 3))
        for batch in batches:
            for block in zip(*(batch.column(k).to_pylist() for k in CODED)):
                tags, length, held, ids, own, weight = (np.frombuffer(b, t) for b, t in zip(block, CODED.values()))
                loss, by_weights, by_moves = likelihood(tags.astype(np.int64), length, held, ids, weight, x[own], x[-3:])
                total[own] += by_weights
                total[-4:-1] += by_moves
                total[-1, 0] += loss
        total[-5] = 0                                        # of the feature that every token has
        rows = np.flatnonzero(total.any(1))
        slices, first = np.unique(rows // SLICE, return_index=True)
        edges = list(zip(first.tolist(), [*first[1:].tolist(), len(rows)]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(slices, pa.int32()), pa.array([TaskContext.get().partitionId()] * len(slices), pa.int32()),
             pa.array([rows[a:b].astype(np.int32).tobytes() for a, b in edges], pa.binary()),
             pa.array([total[rows[a:b]].tobytes() for a, b in edges], pa.binary())], names=["slice", "part", "rows", "slopes"])
    return run


def _summed(batches):
    """The sum of the cells of each slice, which come together and in the order of the tasks."""
    at, total = None, np.zeros((SLICE, 3))

    def out():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                          names=["slice", "slopes"])
    for batch in batches:
        for k, rows, slopes in zip(*(batch.column(c).to_pylist() for c in ("slice", "rows", "slopes"))):
            if k != at:
                if at is not None:
                    yield out()
                at, total = k, np.zeros((SLICE, 3))
            total[np.frombuffer(rows, np.int32) - k * SLICE] += np.frombuffer(slopes).reshape(-1, 3)
    if at is not None:
        yield out()


def minimise(value, x: np.ndarray, steps: int, kept: int = 8, room=np.zeros) -> np.ndarray:
    """L-BFGS from ``x`` on; ``value`` gives a loss and its gradient.  Its vectors are of ``room``,
    and changed part by part."""
    loss, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    d = room(len(x))
    for _ in range(steps):
        fill(d, lambda k: -g[k])
        factors = []
        for s, y in reversed(past):
            factors.append(f := s @ d / (s @ y))
            fill(d, lambda k: d[k] - f * y[k])
        if past:
            s, y = past[-1]
            scale = s @ y / (y @ y)
            fill(d, lambda k: d[k] * scale)
        else:
            most = max(float(g.max()), -float(g.min()), 1e-12)
            fill(d, lambda k: d[k] / most)
        for (s, y), f in zip(past, reversed(factors)):
            f -= y @ d / (s @ y)
            fill(d, lambda k: d[k] + f * s[k])
        slope, rate = float(g @ d), 1.0
        if slope > -1e-7 * max(1.0, abs(loss)):
            break
        at = room(len(x))
        for _ in range(12):
            fill(at, lambda k: x[k] + rate * d[k])
            new_loss, new_g = value(at)
            if new_loss <= loss + 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, y = room(len(x)), room(len(x))
        fill(s, lambda k: rate * d[k])
        fill(y, lambda k: new_g[k] - g[k])
        x, loss, g = at, new_loss, new_g
        if s @ y > 1e-10 * (y @ y):
            past = [*past, (s, y)][-kept:]
    return x


def learn(docs: DataFrame) -> Field:
    """The field, from all texts of ``docs``; without a base span it tags nothing."""
    spark = docs.sparkSession
    texts = docs.where("text IS NOT NULL").select("text")
    counts = np.ones(729)
    for r in texts.mapInArrow(released(_pair_counts), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r.pair] += r.n
    counts = counts.reshape(27, 27)
    pairs = np.log(27 * counts / counts.sum(1, keepdims=True))
    runs = stored(texts.mapInArrow(released(_secret_runs(pairs.tolist())), "tags array<int>, features array<string>, kind string, n long")
                  .groupBy("tags", "features", "kind").agg(F.sum("n").alias("n")), "secret-runs")
    held = {r.kind: r.n for r in runs.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    if "secret" not in held:
        return Field()
    plain = stored(texts.mapInArrow(released(_plain_counts(pairs.tolist())), "features string, kind string, n long")
                   .groupBy("features", "kind").agg(F.sum("n").alias("n")), "plain-tokens")
    rows = {r.kind: r for r in plain.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    held |= {k: r.n for k, r in rows.items()}
    share = {k: AGAINST[k] * held["secret"] / n for k, n in held.items() if k in AGAINST} | {"secret": 1.0}
    weight = F.coalesce(*[F.when(F.col("kind") == k, F.col("n") * F.lit(x)) for k, x in share.items()])
    # a counted token stands behind one of its kind, so that inside is judged too
    out = F.array(F.lit(OUT), F.lit(OUT))
    rows = stored(runs.select("tags", "features", weight.alias("weight")).unionByName(
        plain.select(out.alias("tags"), F.array("features", "features").alias("features"), weight.alias("weight"))), "secret-training")
    total, n = rows.agg(F.sum("weight"), F.count("*")).first()
    names = (rows.select(F.explode("features").alias("f"), "weight")
             .select(F.explode(F.split("f", SEPARATOR)).alias("f"), "weight")
             .groupBy("f").agg(F.sum("weight").alias("w")).where(F.col("w") >= RARE * total))
    parts = names.select("f").mapInArrow(released(_hashed), "keys binary, checks binary, places binary").collect()
    features = Features(*(np.frombuffer(b"".join(r[k] for r in parts), t) for k, t in enumerate((np.uint64, np.uint64, np.uint8))))
    del parts
    index = spark.sparkContext.broadcast(features)
    tasks = max(1, -(-n // TASK_RUNS))
    # rows in one order, so that sums come out alike in every run
    coded = stored(rows.repartition(tasks, "features").sortWithinPartitions("features", "tags", "weight").mapInArrow(
        released(_coded(index)), ", ".join(f"{k} binary" for k in CODED)), "secret-coded")
    index.destroy()
    # rows of three: the features' weights, those of a feature that every token has, the moves
    size, penalty = 3 * (len(features) + 1 + 3), PENALTY * math.sqrt(held["secret"])
    adders = -(-size // (3 * TASK_FEATURES))

    def value(x):
        model = spark.sparkContext.broadcast(x.reshape(-1, 3))
        cells = coded.mapInArrow(released(_gradient(model)), "slice int, part int, rows binary, slopes binary")
        sums = cells.repartition(adders, "slice").sortWithinPartitions("slice", "part").mapInArrow(
            released(_summed), "slice int, slopes binary").collect()
        model.destroy()
        total = on_disk(size + 3)
        for r in sums:
            part = total[3 * SLICE * r.slice:3 * SLICE * (r.slice + 1)]
            part[:] = np.frombuffer(r.slopes)[:len(part)]
        g = total[:size]
        fill(g, lambda k: g[k] + penalty * x[k])
        return float(total[size]) + penalty / 2 * float(x @ x), g

    x = minimise(value, on_disk(size), STEPS, room=on_disk)
    return Field(Weights(features, x[:-9].reshape(-1, 3)), x[-9:].reshape(3, 3), pairs)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _scan(model):
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        field = model.value
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((3, n), np.int64)
            digests, texts = [empty] * n, [""] * n
            column = batch.column("text")
            for i, spans in enumerate(_spans_of(column, field)):
                if not spans:
                    continue
                base = [s for s in spans if s[2] < 3]
                for _, _, k in base:
                    counts[k, i] += 1
                digests[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                texts[i] = _joined(spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, counts), pa.array(digests), pa.array(texts)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return run


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of
    ``docs`` (doc_id, text; other columns ignored).  Spans are kind:start:end in
    code points, by start and then kind (assign, access, hex, crf), comma-joined;
    the digest is of the base kinds alone.  Null text is empty; doc_id may be
    null or repeat."""
    spark = tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = spark.sparkContext.broadcast(learn(docs))
    return docs.mapInArrow(released(_scan(model)), "doc_id long, n_assign long, n_access long, n_hex long, "
                                                   "base_sha256 string, spans string")


def masked(text: str, spans, mark: str) -> str:
    """``text`` with every span, overlapping ones united, replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if b <= at:
            continue
        if a > at or not out:
            out += [text[at:max(a, at)], mark]
        at = max(b, at)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` (doc_id, text, any other columns; n_chars if present brought up to
    date) with every secret replaced by ``mark``; all rows stay."""
    spark = tune(docs.sparkSession)
    model = spark.sparkContext.broadcast(learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))

    @F.pandas_udf("string")
    def clean(text):
        field = model.value
        column = pa.array(text, pa.string(), from_pandas=True)
        out = text.copy()
        for i, spans in enumerate(_spans_of(column, field)):
            if spans:
                out.iloc[i] = masked(text.iloc[i], spans, mark)
        release()
        return out

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", code_points("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
