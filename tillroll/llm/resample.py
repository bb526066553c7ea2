"""Importance resampling of documents towards a target corpus.

Words come with their byte offsets from a Split pre-tokeniser over the lower-cased
text; nothing is trained.  The features of a text are its windows of one to three
words, each the pair of the first word's start and the last word's end.  Their CRC-32
(of the words joined by one space) picks one of a fixed number of buckets.  A bucket's
gain is the log ratio of its shares in the target and in the documents; a text's weight
sums the gains of its features, and seeded Gumbel noise on top of it draws without
replacement.

The CRC of a window is put together from those of its words: the checksum of two
strings in a row is that of the first, moved on by as many zero bytes as the second has,
xor that of the second.  So each byte is read once, in whole-array operations.

The corpus is tokenised once: buckets of all features are written as 16-bit numbers (six
bytes a word, about what the text has) and read back for the histogram and for the
weights.  What reaches the driver is one number a bucket.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.shared import discard, positions, stored, tune
from tillroll.llm.textkit import LOWER, SEGMENT, segments, text_buffer

#: Buckets of the hashed features, and words of the longest window.
BUCKETS, LONGEST = 10_000, 3
#: A word: characters other than ASCII ones that aren't letters or digits (A-Z are lower-cased before).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PART_OF_WORD = np.ones(256, bool)
_PART_OF_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

_U32 = np.uint32
#: Words of at most so many bytes are checksummed side by side.
SHORT = 63


def _step(c: np.ndarray) -> np.ndarray:
    """A CRC register after one zero byte."""
    return _BYTE[c & _U32(255)] ^ (c >> _U32(8))


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=_U32)
    for _ in range(8):
        table = np.where(table & 1, (table >> _U32(1)) ^ _U32(0xEDB88320), table >> _U32(1))
    return table


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map of registers, given by its values on each byte of them."""
    return (tables[0][c & _U32(255)] ^ tables[1][(c >> _U32(8)) & _U32(255)]
            ^ tables[2][(c >> _U32(16)) & _U32(255)] ^ tables[3][c >> _U32(24)])


_BYTE = _byte_table()
#: Registers after 0 to 63 zero bytes, by the four bytes of the register; and after 2**k.
_ZEROS = np.empty((64, 4, 256), _U32)
_ZEROS[0] = np.arange(256, dtype=_U32) << (8 * np.arange(4, dtype=_U32))[:, None]
for _n in range(63):
    _ZEROS[_n + 1] = _step(_ZEROS[_n])
_POWERS = [_ZEROS[1]]
for _n in range(31):
    _POWERS.append(_apply(_POWERS[-1], _POWERS[-1]))


def crc_after(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each checksum moved on by ``size`` zero bytes."""
    low = size & 63
    out = (_ZEROS[low, 0, crc & _U32(255)] ^ _ZEROS[low, 1, (crc >> _U32(8)) & _U32(255)]
           ^ _ZEROS[low, 2, (crc >> _U32(16)) & _U32(255)] ^ _ZEROS[low, 3, crc >> _U32(24)])
    for k in range(6, int(size.max()).bit_length() if len(size) else 0):
        some = (size >> k & 1) == 1
        out[some] = _apply(_POWERS[k], out[some])
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, all words a byte at a time."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, held = starts[order], np.cumsum(np.bincount(size, minlength=SHORT + 2)[::-1])[::-1]    # held[k]: words of k bytes or more
    long = int(held[SHORT + 1])
    crc = np.full(len(size), 0xFFFFFFFF, _U32)
    for k in range(SHORT):
        n = int(held[k + 1])
        if n <= long:
            break
        c = crc[long:n]
        crc[long:n] = _BYTE[(c ^ data[at[long:n] + k]) & _U32(255)] ^ (c >> _U32(8))
    out = np.empty(len(size), _U32)
    out[order] = crc ^ _U32(0xFFFFFFFF)
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[starts[i]:ends[i]])
    return out


def window_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS) -> list[np.ndarray]:
    """Bucket of the windows of one word, of two, ... that begin at each word (as if all
    words were of one text)."""
    size = ends - starts
    one = word_crcs(data, starts, ends)
    spaced = crc_after(np.full(len(size), zlib.crc32(b" "), _U32), size) ^ one       # of a space and the word
    out = [one]
    for k in range(1, LONGEST):
        last = out[-1]
        out.append(crc_after(last[:-1], size[k:] + 1) ^ spaced[k:] if len(last) > 1 else last[:0])
    return [(c % _U32(buckets)).astype("<u2") for c in out]


_SPLITTERS: list = []


def word_offsets(data: np.ndarray, first: int, last: int) -> list[int]:
    """Start and end of each word of the lower-cased UTF-8 text ``data[first:last]``, one
    after another, as places in ``data``, by the pre-tokeniser; a long text is given to it
    in pieces that end behind a word."""
    from tokenizers import PreTokenizedString, Regex, pre_tokenizers

    if not _SPLITTERS:
        _SPLITTERS.append(pre_tokenizers.Split(Regex(WORD), "removed", invert=True))
    out: list[int] = []
    while first < last:
        stop = last
        if last - first > SEGMENT:
            gap = np.flatnonzero(~_PART_OF_WORD[data[first + SEGMENT:last]])
            stop = first + SEGMENT + int(gap[0]) if len(gap) else last
        text = PreTokenizedString(data[first:stop].tobytes().decode("utf-8"))
        _SPLITTERS[0].pre_tokenize(text)
        out += [x + first for _, pair, _ in text.get_splits("original", "byte") for x in pair]
        first = stop
    return out


def _features(buckets: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            data, words, held = LOWER[data], [], []
            for first, last in segments(offsets):
                places: list[int] = []
                for a, b in zip(offsets[first:last].tolist(), offsets[first + 1:last + 1].tolist()):
                    before = len(places)
                    places += word_offsets(data, a, b)
                    words.append((len(places) - before) // 2)
                places = np.array(places, np.int64)
                windows = window_buckets(data, places[::2], places[1::2], buckets)
                at = 0
                for n in words[first:]:
                    held.append(b"".join([w[at:max(at, at + n - k)].tobytes() for k, w in enumerate(windows)]))
                    at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(held, pa.binary())],
                names=["doc_id", "n_words", "buckets"])
    return run


def features(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, buckets) of every row: the buckets of all its features as
    little-endian 16-bit numbers, repeats included."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_features(buckets), "doc_id long, n_words long, buckets binary")


def _histogram(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for held in batch.column("buckets"):
                total += np.bincount(np.frombuffer(held.as_buffer(), "<u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])
    return run


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all rows fall in each bucket."""
    return (rows.select("buckets").mapInArrow(_histogram(buckets), "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) from two histograms: floor of 1000 times the log of the target's
    share over the source's, each count one more than it is."""
    of = lambda df, n: df.select("bucket", F.col("n").alias(n))
    both = of(source, "s").join(of(target, "t"), "bucket", "full").na.fill(0, ["s", "t"])
    totals = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("sum_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("sum_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("sum_s") + buckets) / ((d("s") + 1) * (d("sum_t") + buckets))
    return both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _weights(gain: np.ndarray):
    def run(batches):
        for batch in batches:
            weights, sizes = [], []
            for held in batch.column("buckets"):
                own = np.frombuffer(held.as_buffer(), "<u2")
                sizes.append(len(own))
                weights.append(int(gain[own].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(sizes, pa.int64()),
                 pa.array(weights, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])
    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42,
             buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text),
    drawn towards the texts of ``target`` (text; other columns of both are ignored).

    Of the documents with ``least_words`` words or more, ``percent`` % (rounded down)
    with the highest scores are drawn, ties to the smaller doc_id, and ranked from 1; the
    others have no rank.  Null and empty texts have no features and weight 0.  A row
    without a doc_id has no noise, so neither score nor rank, and doesn't count.  Rows that
    repeat a doc_id count each; among those of one score, more features, then the greater
    weight goes first.  An empty target leaves the gains to the source alone; an empty table
    gives an empty result.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are stored as 16-bit numbers")
    rows = stored(features(docs, buckets), "features")
    wanted = stored(features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets), "target-features")
    gain = np.zeros(buckets, np.int64)
    for bucket, value in gains(histogram(rows, buckets), histogram(wanted, buckets), buckets).collect():
        gain[bucket] = value
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((draw.cast("double") + 0.5) / 4294967296.0))).cast("long")
    scored = rows.mapInArrow(_weights(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = stored(scored.withColumn("score", F.col("weight") + noise), "scores")
    discard(rows, wanted)
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    placed = positions(scored.where(able), [], [F.desc("score"), F.asc("doc_id"), F.desc("n_features"), F.desc("weight")])
    drawn = F.floor(F.col("total") * percent / 100).cast("long")
    rank = F.when(F.col("pos") < drawn, F.col("pos") + 1).cast("long")
    names = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*names, rank.alias("rank")).unionByName(
        scored.where(~able).select(*names, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, percent: int = 5, **settings) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn, with all their columns."""
    ids = resample(docs, target, percent, **settings).where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(ids.withColumnRenamed("doc_id", "_drawn"), F.col("doc_id") == F.col("_drawn"), "left_semi")
