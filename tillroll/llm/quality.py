"""Quality scoring by weak supervision, in DataFrame functions only.

Rules look at simple measures of a text and vote good (1), bad (-1) or abstain
(0).  Expectation-maximisation estimates, without labels, how often each rule
votes good and bad on good and on bad documents, and the posterior probability
of being good replaces "all rules must pass".  The votes of the whole corpus are first
counted by pattern (at most 3^rules, whatever the corpus), so the iterations
are a fold over one small array and cost no further pass.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.shared import free_name, split_by_keys, stored, tune

#: Steps of expectation-maximisation; the prior belief in each rule's rates (how
#: often it votes good and bad on a good document, then on a bad one), its
#: strength in documents, and the share of good documents to start from.
STEPS, PRIOR_DOCS, PRIOR_GOOD = 40, 20.0, 0.9
PRIOR_RATES = {"gp": 0.5, "gn": 0.02, "bp": 0.2, "bn": 0.4}
LEAST_RATE = 0.001
WINDOW = 8

WORD = r"[^\x20\x09-\x0D]+"
PLAIN = r"""^["'“‘(\[]?[\p{L}\p{N}]+([-'’.@][\p{L}\p{N}]+)*[.,;:!?]?["'”’)\]]?$"""

#: rule: (good where, bad where); abstains where neither holds.  A defect that is
#: absent says little, so most rules only ever vote bad or abstain.
RULES = {
    "length": ("FALSE", "n_words < 20"),
    "word_length": ("2 * word_chars BETWEEN 7 * n_words AND 14 * n_words",
                    "2 * word_chars < 5 * n_words OR 2 * word_chars > 19 * n_words"),
    "symbols": ("100 * n_symbols <= 2 * n_words", "100 * n_symbols > 10 * n_words"),
    "duplicate_lines": ("FALSE", "10 * n_dup_lines >= 4 * n_lines"),
    "repeated_words": ("FALSE", "100 * n_repeat_words > 30 * n_words"),
    "stutter": ("FALSE", "100 * n_stutter > 15 * n_words"),
    "plain_words": ("100 * n_plain >= 90 * n_words", "100 * n_plain < 70 * n_words"),
    "distinct_words": ("100 * n_distinct >= 45 * least(n_words, 2000)",
                       "100 * n_distinct < 25 * least(n_words, 2000)"),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_plain", "n_distinct", "n_stutter")


def measures(docs: DataFrame, carry: list[str]) -> DataFrame:
    """(_row, _m): the carried columns and the measures that the rules read.

    n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``),
    n_dup_lines (lines with a word, equal to an earlier one), n_repeat_words
    (words in 8-word windows that occur twice or more, the first included),
    n_lines (with a word), n_plain (words of letters and digits with usual
    punctuation), n_distinct, n_stutter (equal to the word before).
    Null and empty texts have none of anything.
    """
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_row"),
                       F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    text = F.col("_text")
    # the array steps stand apart, so that none is computed twice
    out = docs.withColumn("_w", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    out = out.withColumn("_h", F.expr(
        f"""CASE WHEN size(_w) > {WINDOW}
            THEN transform(sequence(1, size(_w) - {WINDOW - 1}), i -> xxhash64(slice(_w, i, {WINDOW})))
            ELSE array() END"""))
    out = out.withColumn("_l", F.expr(
        r"filter(split(_text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    repeated = F.expr("""
        CASE WHEN size(array_distinct(_h)) = size(_h) THEN 0L ELSE
          aggregate(
            sort_array(transform(array(sort_array(transform(_h, (h, i) -> struct(h AS h, i AS i)))), s ->
              filter(transform(s, (x, k) ->
                CASE WHEN x.h = get(s, k - 1).h OR x.h = get(s, k + 1).h THEN x.i END), i -> i IS NOT NULL))[0]),
            struct(0 AS stop, 0L AS n),
            (s, i) -> struct(i + %d AS stop, s.n + i + %d - greatest(s.stop, i) AS n),
            s -> s.n) END""" % (WINDOW, WINDOW))
    measured = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda w: w.rlike(PLAIN))).cast("long").alias("n_plain"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.size(F.filter("_w", lambda w, i: w == F.get("_w", i - 1))).cast("long").alias("n_stutter"))
    return out.select("_row", measured.alias("_m"))


def votes(rules: dict[str, tuple[str, str]] = RULES) -> Column:
    """Array of the rules' votes on the measures."""
    of = lambda rule: re.sub(rf"\b({'|'.join(MEASURES)})\b", r"_m.\1", rule)
    return F.array(*(F.expr(f"CASE WHEN {of(good)} THEN 1 WHEN {of(bad)} THEN -1 ELSE 0 END")
                     for good, bad in rules.values()))


def _log_odds(vote: str, model: str) -> str:
    """Log odds of good given a vote array and the rules' rates.  A good vote
    never speaks against a document, a bad one never for it."""
    return f"""aggregate(zip_with({vote}, arrays_zip({model}.gp, {model}.gn, {model}.bp, {model}.bn), (v, r) ->
        CASE WHEN v > 0 THEN greatest(0D, ln(r.gp / r.bp)) WHEN v < 0 THEN least(0D, ln(r.gn / r.bn)) ELSE 0D END),
        ln({model}.p / (1 - {model}.p)), (s, x) -> s + x)"""


def estimate(voted: DataFrame, rules: int) -> DataFrame:
    """One row ``model``: p, the share of good documents, and by rule the rates of
    good and bad votes on good documents (gp, gn) and on bad ones (bp, bn)."""
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("c"))
    first = ", ".join([f"named_struct('p', {PRIOR_GOOD}D",
                       *(f"'{k}', array_repeat({v}D, {rules})" for k, v in PRIOR_RATES.items())]) + ")"

    def rate(name: str) -> str:
        side, sign = ("good", "bad")[name[0] == "b"], ("> 0", "< 0")[name[1] == "n"]
        votes_so = f"aggregate(w, 0D, (s, x) -> s + CASE WHEN get(x.votes, j) {sign} THEN x.{side} ELSE 0D END)"
        return (f"'{name}', transform(sequence(0, {rules - 1}), j -> greatest({LEAST_RATE}D, "
                f"({votes_so} + {PRIOR_RATES[name] * PRIOR_DOCS}D) / ({total(side)} + {PRIOR_DOCS}D)))")

    total = lambda side: f"aggregate(w, 0D, (s, x) -> s + x.{side})"
    weighted = f"""transform(transform(patterns, x -> named_struct('votes', x.votes, 'c', x.c,
        'q', 1 / (1 + exp(-({_log_odds('x.votes', 'm')}))))),
        x -> named_struct('votes', x.votes, 'good', x.c * x.q, 'bad', x.c * (1 - x.q)))"""
    step = f"""transform(array({weighted}), w -> named_struct(
        'p', least(0.9999D, greatest(0.0001D, ({total('good')} + {PRIOR_GOOD}D)
                   / ({total('good')} + {total('bad')} + 1D))),
        {', '.join(map(rate, PRIOR_RATES))}))[0]"""
    return (patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "c"))).alias("patterns"))
            .select(F.expr(f"aggregate(sequence(1, {STEPS}), {first}, (m, i) -> {step})").alias("model")))


def score(docs: DataFrame, carry: list[str] | None = None,
          rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """(_row, _m, base_failed, quality, kept) of every row of ``docs`` (needs text):
    a struct of the carried columns (all, if not given), the measures, and the
    verdict.

    base_failed: fewer than 20 words, or over 30 % of them in repeated 8-word
    windows.  quality: posterior probability of being good.  kept: not
    base_failed and a quality of at least one half.  Null and empty texts fail.
    Rows are judged each on its own, so ids may be null or repeat; an empty
    table gives an empty result.  The measured rows are stored once; the model
    is one row, joined to all.
    """
    tune(docs.sparkSession)
    measured = measures(docs, docs.columns if carry is None else carry)
    voted = stored(measured.select("_row", "_m", votes(rules).alias("_votes")), "measures")
    model = estimate(voted.select(F.col("_votes").alias("votes")), len(rules))
    odds = F.expr(_log_odds("_votes", "model"))
    failed = F.expr("_m.n_words < 20 OR 100 * _m.n_repeat_words > 30 * _m.n_words")
    return (voted.crossJoin(F.broadcast(model))
            .select("_row", "_m", failed.alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("quality"))
            .select("_row", "_m", "base_failed", "quality",
                    (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept")))


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, quality) of every row of ``docs`` (doc_id, text)."""
    return score(docs, ["doc_id"]).select(
        "_row.doc_id", *(f"_m.{m}" for m in MEASURES[:5]), "base_failed", "kept", "quality")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged.

    Equal texts get equal verdicts, so rows are matched with the rejected texts
    by two 64-bit hashes of the text, the second from a seed of its own: ids may be null or repeat, and only rows
    that may be rejected are shuffled.
    """
    keys = [free_name(k, docs.columns) for k in ("text1", "text2")]
    hashes = [F.xxhash64("text").alias(keys[0]), F.xxhash64(F.lit(1), "text").alias(keys[1])]
    judged = score(docs.select("text", *hashes), keys)
    rejected = stored(judged.where("NOT kept").select("_row.*").distinct(), "rejected")
    some, rest = split_by_keys(docs.select("*", *hashes), rejected, keys[0])
    return some.join(rejected, keys, "left_anti").unionByName(rest).select(*docs.columns)
