"""Hierarchical language identification.

A text becomes counts of hashed byte trigrams (lower-cased, everything but
letters a space).  Linear support vector machines first tell language families
apart, one against one; then, within the chosen family, one machine for each
pair of its languages decides between close relatives.  The machines are
trained on a bounded, hash-chosen sample of labelled rows; prediction reads
every whole text once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.shared import stored, tune

#: Hashed trigram dimensions; labelled rows learned from, over all languages (the
#: expected size of the sample: a language gets an equal share of it).
DIMENSIONS, SAMPLE_ROWS = 4096, 2400
#: Bytes worked on at a time.
SLICE = 1 << 20

# Languages of the larger families (others are a family of their own).
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi", "fo"],
    "romance": ["fr", "es", "pt", "it", "ro", "ca", "gl", "oc", "la", "ast", "sc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "ky", "uz", "tk"],
    "indic": ["hi", "ur", "bn", "mr", "ne", "pa", "gu"],
    "semitic": ["ar", "he", "mt", "am"],
    "celtic": ["ga", "gd", "cy", "br"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)
_LETTER = regex.compile(r"\p{L}")


def trigram_rows(column: pa.Array, dimensions: int = DIMENSIONS):
    """Yield (row, counts of hashed trigrams, whether the text has a letter); null
    is empty.  A text is taken in slices, so its length doesn't matter."""
    lowered = pc.utf8_lower(column.fill_null("") if column.null_count else column)
    for row, (text, low) in enumerate(zip(column.to_pylist(), lowered.to_pylist())):
        counts = np.zeros(dimensions)
        data = _CLEAN[np.frombuffer(b" " + low.encode() + b" ", np.uint8)]
        for at in range(0, max(len(data) - 2, 0), SLICE):
            part = data[at:at + SLICE + 2].astype(np.uint32)
            code = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
            code = code[part[1:-1] != 0x20]
            code = (code * np.uint32(2654435761)) >> np.uint32(20)
            counts += np.bincount(code % np.uint32(dimensions), minlength=dimensions)
        yield row, counts, bool(text) and _LETTER.search(text) is not None


def normalised(counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts, to unit length, and a constant for the offset."""
    x = np.sqrt(counts)
    norm = np.sqrt((x * x).sum(-1, keepdims=True))
    x = x / np.where(norm > 0, norm, 1)
    return np.concatenate((x, np.full(x.shape[:-1] + (1,), 0.3)), -1)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """Weights of a linear SVM (hinge loss) by dual coordinate ascent; y is 1 or -1."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square = (x * x).sum(1)
    weight = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            step = (1 - y[i] * (x[i] @ w)) / square[i]
            new = min(max(alpha[i] + step, 0.0), cost * weight[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class OneVersusOne:
    """A machine for each pair of classes; the class with most votes wins, ties by
    the sum of margins."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels.tolist()))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.weights = np.zeros((x.shape[1], len(self.pairs)))
        for p, (a, b) in enumerate(self.pairs):
            mine = (labels == self.classes[a]) | (labels == self.classes[b])
            self.weights[:, p] = train_svm(x[mine], np.where(labels[mine] == self.classes[a], 1, -1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class index and confidence (logistic of the winner's least margin)."""
        n, k = len(x), len(self.classes)
        if k == 1:
            return np.zeros(n, np.int64), np.ones(n)
        margins = x @ self.weights
        votes, sums, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for p, (a, b) in enumerate(self.pairs):
            for c, m in ((a, margins[:, p]), (b, -margins[:, p])):
                votes[:, c] += m > 0
                sums[:, c] += np.tanh(m)
                least[:, c] = np.minimum(least[:, c], m)
        best = (votes + sums / (2 * k)).argmax(1)
        return best, 1 / (1 + np.exp(-np.clip(3 * least[np.arange(n), best], -30, 30)))


class Hierarchy:
    """Families first, then the languages of the chosen family."""

    def __init__(self, counts: np.ndarray, langs: list[str]):
        x, langs = normalised(counts), np.array(langs, object)
        families = np.array([FAMILY_OF.get(lang, lang) for lang in langs], object)
        self.families = OneVersusOne(x, families)
        self.within = {f: OneVersusOne(x[families == f], langs[families == f]) for f in self.families.classes}

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = normalised(counts)
        family, score = self.families.predict(x)
        out = [""] * len(x)
        for f in np.unique(family).tolist():
            rows = np.flatnonzero(family == f)
            machine = self.within[self.families.classes[f]]
            which, inner = machine.predict(x[rows])
            score[rows] = score[rows] * inner
            for r, w in zip(rows.tolist(), which.tolist()):
                out[r] = machine.classes[w]
        return out, score


def _features(batches):
    for batch in batches:
        index, value = [], []
        for _, counts, _ in trigram_rows(batch.column("text")):
            some = np.flatnonzero(counts)
            index.append(some.astype(np.int32))
            value.append(counts[some])
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float64()))],
            names=["lang", "i", "v"])


def _labels(model):
    def run(batches):
        found = model.value
        for batch in batches:
            rows, letters, langs, scores = [], [], [], []

            def flush():
                if rows:
                    some, sure = found.predict(np.stack(rows)) if found else (["und"] * len(rows), [0.0] * len(rows))
                    langs.extend(g if has else "und" for g, has in zip(some, letters))
                    scores.extend(float(s) if has else 0.0 for s, has in zip(sure, letters))
                    rows.clear()
                    letters.clear()

            for _, counts, has in trigram_rows(batch.column("text")):
                rows.append(counts)
                letters.append(has)
                if len(rows) == 256:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"])
    return run


def learn(docs: DataFrame, may_learn: Column, rows: int = SAMPLE_ROWS) -> Hierarchy | None:
    """The machines, from rows with text, lang and doc_id for which ``may_learn``
    holds; None without any.  Of each language about rows / languages are taken,
    chosen by a hash of doc_id (all, if it has fewer)."""
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(may_learn)
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), "lang").limit(rows).collect()}          # languages, at most ``rows``
    if not sizes:
        return None
    share = max(1, rows // len(sizes))
    spark = docs.sparkSession
    odds = spark.createDataFrame([(k, min(1.0, share / n)) for k, n in sorted(sizes.items())],
                                 "lang string, odds double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    sample = (labelled.select("doc_id", "text", "lang").join(F.broadcast(odds), "lang")
              .where(draw < F.col("odds")).select("doc_id", "text", "lang"))
    got = (stored(sample.mapInArrow(_features, "lang string, i array<int>, v array<double>"), "language-sample")
           .orderBy(F.xxhash64("lang", "i")).limit(2 * rows).collect())
    if not got:
        return None
    counts = np.zeros((len(got), DIMENSIONS), np.float32)
    for k, r in enumerate(got):
        counts[k, r["i"]] = r["v"]
    return Hierarchy(counts, [r["lang"] for r in got])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text,
    lang; other columns ignored).

    Learned only from rows with a text, a lang and a doc_id whose crc32 (of the id
    as text) modulo 4 isn't 2; held_out says that it is (false for a null id).
    lang_pred is a learned language, ``und`` with score 0 for a null text, one
    without letters, or if nothing could be learned; repeated rows get equal
    predictions.
    """
    spark = tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = spark.sparkContext.broadcast(learn(docs, ~held_out(), rows))
    found = docs.select("doc_id", "text").mapInArrow(_labels(model), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
