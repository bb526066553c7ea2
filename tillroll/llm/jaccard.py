"""Set-similarity join on word n-grams: documents linked by Jaccard similarity.

Two documents link when ``|A & B| / |A | B| >= share`` for their sets of
distinct ``words``-word shingles.  The result is exact:

1. Documents with equal sets form a class; everything after works on classes,
   so thousands of copies cost one.
2. Elimination.  Order each set by hash; with p = n - ceil(share*n) + 1, the
   first 2p - 1 grams of two linked sets have min(p, p') grams in common (at
   most p - 1 grams of either set are missing from the other).  A class stays
   only if so many of its first grams are shared at all.  Grams travel in
   packed cells and equal ones are combined in each task.
3. Rare-first prefix filter among the remaining classes: grams are ordered by
   the number of remaining classes that hold them, linked sets share a gram of
   their p rarest, grams held by one class can't match.  Candidates meet on
   prefix grams and pass a length and a positional filter.
4. Links.  A bucket of m classes is never expanded into m*m/2 pairs: each class
   is first verified against a few centres of its buckets, links are contracted
   to components, and then only candidates whose components still differ are
   verified, each pair once (suffix filter, then the exact intersection).
   Pairs inside one component can't change the result.

Where many different texts are nearly but not quite linked, step 4 must verify
all those pairs; nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm import exchange as X
from tillroll.llm.components import components
from tillroll.llm.shared import discard, free_name, released, shuffle_parts, split_by_keys, stored, tune
from tillroll.llm.textkit import gram_hashes, mix, word_hashes

#: Grams that a task gathers before it sends packed cells (about 16 bytes each).
BLOCK_GRAMS = 1_500_000
#: Centres tried per bucket, and per class, before the exact round.
CENTRES, TRIES = 4, 2


def need(n: int, num: int, den: int) -> int:
    """Least intersection of a set of size n with any linked set: ceil(n * share)."""
    return -(-n * num // den)


def prefix_size(n: int, num: int, den: int) -> int:
    return n - need(n, num, den) + 1


def shingle_sets(column: pa.Array, words: int):
    """Sorted distinct shingle hashes of each row; a text with fewer words is
    one shingle, without words none."""
    for _, hashes, counts in word_hashes(column, lower=True):
        grams = gram_hashes(hashes, words)
        at = 0
        for n in counts.tolist():
            if n >= words:
                yield np.unique(grams[at:at + n - words + 1])
            elif n:
                yield mix(gram_hashes(hashes[at:at + n], n) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)
            at += n


def class_of(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _describe(words: int):
    def run(batches):
        for batch in batches:
            sizes, keys = [], []
            for s in shingle_sets(batch.column("text"), words):
                sizes.append(len(s))
                keys.append(class_of(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())],
                names=["doc_id", "n_shingles", "cls"])
    return run


def _cells(words: int, num: int, den: int, parts: int):
    """First grams of each class as packed cells; of equal grams in a task only
    one travels, and classes that share it here are counted at once."""
    schema = pa.schema([("part", pa.int32()), ("grams", pa.binary()), ("classes", pa.binary()),
                        ("refs", pa.binary())])

    def block(sets: dict[bytes, np.ndarray]):
        names = list(sets)
        grams = np.concatenate([sets[k] for k in names])
        owner = np.repeat(np.arange(len(names)), [len(sets[k]) for k in names])
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        held = np.diff(np.append(first, len(grams)))
        shared = np.repeat(held > 1, held)
        counts = np.bincount(owner[shared], minlength=len(names))
        rows = []
        to = X.part_of(grams[first], parts)
        cuts = np.searchsorted(to, np.arange(parts + 1))
        blob = np.frombuffer(b"".join(names), dtype="V16")
        for part in range(parts):
            mine = first[cuts[part]:cuts[part + 1]]
            if len(mine):
                own, ref = np.unique(owner[mine], return_inverse=True)
                flag = (held[cuts[part]:cuts[part + 1]] > 1).astype(np.uint64)
                rows.append((part, X.pack_sorted(grams[mine]), blob[own].tobytes(),
                             X.pack_ints(ref.astype(np.uint64) * np.uint64(2) + flag)))
        known = np.flatnonzero(counts)
        if len(known):
            home = np.frombuffer(b"".join(names), np.uint64).reshape(-1, 2)[known, 0] % np.uint64(parts)
            for part in np.unique(home):
                mine = known[home == part]
                rows.append((int(part), None, blob[mine].tobytes(), X.pack_ints(counts[mine])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)],
                                          schema=schema)

    def run(batches):
        sets, total = {}, 0
        for batch in batches:
            for s in shingle_sets(batch.column("text"), words):
                key = class_of(s)
                if key is None or key in sets:
                    continue
                head = s[:2 * prefix_size(len(s), num, den) - 1]
                sets[key] = mix(head)
                total += len(head)
                if total >= BLOCK_GRAMS:
                    yield block(sets)
                    sets, total = {}, 0
        if sets:
            yield block(sets)
    return run


def _packed_counts(total: dict[bytes, int], parts: int) -> pa.RecordBatch:
    """Counts by class, dealt out by class: one row for each partition."""
    names = np.frombuffer(b"".join(total), dtype="V16")
    counts = np.fromiter(total.values(), np.int64, len(total))
    home = names.view(np.uint64)[::2] % np.uint64(parts) if len(names) else np.zeros(0, np.uint64)
    rows = [(int(p), names[home == p].tobytes(), X.pack_ints(counts[home == p])) for p in np.unique(home)]
    part, classes, packed = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(classes, pa.binary()),
                                       pa.array(packed, pa.binary())], names=["part", "classes", "counts"])


def _sum_counts(batches):
    total: dict[bytes, int] = {}
    for batch in batches:
        for c, r in zip(batch.column("classes").to_pylist(), batch.column("counts").to_pylist()):
            for i, v in enumerate(X.unpack_ints(r).tolist()):
                key = c[16 * i:16 * i + 16]
                total[key] = total.get(key, 0) + v
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()),
                                      pa.array(list(total.values()), pa.int64())], names=["cls", "c"])


def _merge_cells(batches) -> dict[bytes, int]:
    """Merge the cells of a partition: how many of its grams here each class
    shares with another class (a class of several tasks may count twice)."""
    grams, refs, flags, names, total = [], [], [], [], {}
    base = 0
    for batch in batches:
        for g, c, r in zip(*(batch.column(k).to_pylist() for k in ("grams", "classes", "refs"))):
            keys = [c[i:i + 16] for i in range(0, len(c), 16)]
            values = X.unpack_ints(r)
            if g is None:
                for k, v in zip(keys, values.tolist()):
                    total[k] = total.get(k, 0) + v
                continue
            grams.append(X.unpack_sorted(g))
            refs.append((values >> np.uint64(1)).astype(np.int64) + base)
            flags.append((values & np.uint64(1)).astype(bool))
            names.extend(keys)
            base += len(keys)
    if grams:
        unique = {}
        same = np.array([unique.setdefault(k, len(unique)) for k in names])
        gram, owner, flag = np.concatenate(grams), same[np.concatenate(refs)], np.concatenate(flags)
        order = np.argsort(gram, kind="stable")
        gram, owner, flag = gram[order], owner[order], flag[order]
        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        many = (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first))
        many |= np.logical_or.reduceat(flag, first)
        held = np.diff(np.append(first, len(gram)))
        found = np.bincount(owner[np.repeat(many, held) & ~flag], minlength=len(unique))
        for k, v in zip(unique, found.tolist()):
            if v:
                total[k] = total.get(k, 0) + v
    return total


def _shared_counts(parts: int):
    def run(batches):
        yield _packed_counts(_merge_cells(batches), parts)
    return run


def _sets_of(words: int):
    def run(batches):
        for batch in batches:
            want = batch.column("cls").to_pylist()
            keys, sizes, sets = [], [], []
            for k, s in zip(want, shingle_sets(batch.column("text"), words)):
                if class_of(s) == k:
                    keys.append(k)
                    sizes.append(len(s))
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(sets, pa.list_(pa.int64()))], names=["cls", "n", "grams"])
    return run


def overlap_needed(na: int, nb: int, num: int, den: int) -> int:
    """Least intersection of two linked sets of these sizes."""
    return -(-num * (na + nb) // (num + den))


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 2) -> int:
    """Upper bound of the intersection of two ascending arrays: cut both at the
    middle value of the first, the halves can't match across the cut."""
    if depth == 0 or len(a) < 8 or len(b) < 8:
        return min(len(a), len(b))
    mid = len(a) // 2
    cut = int(np.searchsorted(b, a[mid]))
    return suffix_bound(a[:mid], b[:cut], depth - 1) + suffix_bound(a[mid:], b[cut:], depth - 1)


def _verify(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            rows = zip(*(batch.column(k).to_numpy(zero_copy_only=False)
                         for k in ("na", "nb", "ga", "gb")))
            for na, nb, ga, gb in rows:
                least = overlap_needed(int(na), int(nb), num, den)
                ga, gb = np.sort(ga), np.sort(gb)
                if suffix_bound(ga, gb) < least:
                    keep.append(False)
                    continue
                both = np.concatenate((ga, gb))
                both.sort()
                keep.append(int(np.count_nonzero(both[1:] == both[:-1])) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")],
                                             names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _needed(n, num: int, den: int):
    return F.ceil(F.expr(f"({n} * {num}) / {den}D")).cast("long")


def _candidates(left: DataFrame, right: DataFrame, num: int, den: int) -> DataFrame:
    """Classes that meet on a prefix gram (left: h, cls, n, single, pos; right: the
    same with a 2) and pass the length and the positional filter: grams that no
    other class holds can't match, of the others before this gram no more than
    either has, of those behind it likewise.  Where both sides know the shared
    grams ``before``, a pair meets once only, on its first common gram, and
    nothing before it matches."""
    once = "before" in left.columns
    least = F.ceil(F.expr(f"({num} * (n + n2)) / {num + den}D"))
    before = F.lit(0) if once else F.least(F.expr("pos - single"), F.expr("pos2 - single2"))
    most = before + F.lit(1) + F.least(F.expr("n - pos - 1"), F.expr("n2 - pos2 - 1"))
    met = (left.join(right, "h").where("cls <> cls2")
           .where(F.expr(f"{den} * least(n, n2) >= {num} * greatest(n, n2)"))
           .where(most >= least))
    return met.where(~F.arrays_overlap("before", "before2")) if once else met


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text;
    other columns are ignored, whatever their names).

    Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; a text of
    fewer than ``words`` words is one shingle.  component_id is the smallest
    doc_id reachable over links (itself included).  Null, empty and blank texts
    have no shingle and link with nothing.  A row without a doc_id takes no part
    in links; it gets the component of the documents with an equal set, or null.
    Repeated rows come back as often as they came in; rows that share a doc_id
    but not the text are judged each by its own text.  An empty table gives an
    empty result.
    """
    table, named = _described(docs, words, num, den)
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = named.select("cls", "root").join(smallest, "root").select("cls", "component_id")
    return table.join(of_class, "cls", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _described(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, cls) of every row, and (cls, doc_id, root) of every
    class, with its smallest doc_id and the name of its component."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = stored(docs.mapInArrow(released(_describe(words)), "doc_id long, n_shingles long, cls binary"), "sets")
    classes = (table.where("cls IS NOT NULL").groupBy("cls")
               .agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")))
    roots = class_components(docs, classes, words, num, den)
    named = classes.select("cls", "doc_id").join(roots, "cls", "left").select(
        "cls", "doc_id", F.coalesce("root", "cls").alias("root"))
    return table, stored(named, "class-roots")


def class_components(docs: DataFrame, classes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(cls, root) of the classes that link with another class."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    cells = docs.where("doc_id IS NOT NULL").mapInArrow(
        released(_cells(words, num, den, parts)), "part int, grams binary, classes binary, refs binary")
    shared = (cells.repartitionById(parts, "part")
              .mapInArrow(released(_shared_counts(parts)), "part int, classes binary, counts binary")
              .repartitionById(parts, "part").mapInArrow(released(_sum_counts), "cls binary, c long"))
    m = _needed("n", num, den)
    rest = (classes.where("doc_id IS NOT NULL").join(shared, "cls").withColumn("m", m)
            .where(F.col("c") >= F.col("m") - _needed("m", num, den) + 1))
    rest = stored(rest.select("cls", "doc_id"), "survivors")

    some, _ = split_by_keys(docs, rest, "doc_id")
    sets = stored(some.join(rest, "doc_id")
                  .mapInArrow(released(_sets_of(words)), "cls binary, n long, grams array<long>"), "gram-sets")
    grams = sets.select("cls", "n", F.explode("grams").alias("h"))
    held = grams.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ranked = (grams.join(held, "h").groupBy("cls", "n")
              .agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("g"))
              .select("cls", "n", F.col("g.h").alias("grams"))
              .where(F.size("grams") >= _needed("n", num, den)))
    ranked = stored(ranked, "ranked-sets")
    single = F.col("n") - F.size("grams")
    prefix = (ranked.withColumn("single", single)
              .withColumn("p", (F.col("n") - _needed("n", num, den) + 1 - F.col("single")).cast("int"))
              .where("p > 0")
              .select("cls", "n", "single", F.posexplode(F.expr("slice(grams, 1, p)")).alias("i", "h"))
              .select("h", "cls", "n", "single", (F.col("single") + F.col("i")).alias("pos")))
    prefix = stored(prefix, "prefixes")

    # a few centres of each bucket: almost all links of a group of near copies.  The
    # first has the smallest share of grams of its own (the least edited copy).
    second = [F.col(c).alias(f"{c}2") for c in ("cls", "n", "single", "pos")]
    row = F.struct(*second)
    ranks = [F.struct(F.col("single") / F.col("n"), "cls"),
             *(F.struct(F.xxhash64("h", "cls", F.lit(s))) for s in range(1, CENTRES))]
    centres = (prefix.groupBy("h")
               .agg(F.count("*").alias("m"), *(F.min_by(row, r).alias(f"c{s}") for s, r in enumerate(ranks)))
               .where("m > 1")
               .select("h", F.explode(F.array_distinct(F.array(*(f"c{s}" for s in range(CENTRES))))).alias("c"))
               .select("h", "c.*"))
    # stored, so that the join deals out both sides for itself and can split a hot gram
    centres = stored(centres, "centres")
    best = Window.partitionBy("cls").orderBy(F.desc("hits"), "cls2")
    tried = (_candidates(prefix, centres, num, den).groupBy("cls", "cls2").agg(F.count("*").alias("hits"))
             .withColumn("r", F.row_number().over(best)).where(F.col("r") <= TRIES)
             .select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")).distinct())
    tried = stored(tried, "tried-pairs")
    roots = stored(components(_linked(tried, ranked, num, den)), "roots")

    # the exact round: what still differs within a bucket
    own = prefix.join(roots.select(F.col("id").alias("cls"), "root"), "cls", "left").withColumn(
        "comp", F.coalesce("root", "cls")).drop("root")
    labelled = own = stored(own, "labelled-prefixes")
    per = own.groupBy("h", "comp").agg(F.count("*").alias("m"))
    mixed = per.groupBy("h").agg(F.count("*").alias("k"), F.max_by("comp", "m").alias("big")).where("k > 1")
    mixed = stored(mixed.select("h", "big"), "mixed-grams")
    own = (own.join(mixed, "h").join(ranked.select("cls", "grams"), "cls")
           .withColumn("before", F.expr("slice(grams, 1, CAST(pos - single AS INT))")).drop("grams"))
    own = stored(own, "open-prefixes")
    discard(labelled)
    right = own.select("h", *second, F.col("comp").alias("comp2"), F.col("before").alias("before2"))
    open_pairs = (_candidates(own.where("comp <> big"), right, num, den).where("comp <> comp2")
                  .where("comp2 = big OR cls < cls2")
                  .select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b"))
                  .distinct().join(tried, ["a", "b"], "left_anti"))
    more = _linked(open_pairs, ranked, num, den)
    name = lambda side: roots.select(F.col("id").alias(side), F.col("root").alias(f"{side}r"))
    lifted = (more.join(name("a"), "a", "left").join(name("b"), "b", "left")
              .select(F.coalesce("ar", "a").alias("a"), F.coalesce("br", "b").alias("b")))
    upper = components(lifted)
    first = roots.select(F.col("id").alias("cls"), "root")
    joined = (first.join(upper.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left")
              .select("cls", F.coalesce("top", "root").alias("root")))
    alone = (upper.join(first.select(F.col("cls").alias("id")), "id", "left_anti")
             .select(F.col("id").alias("cls"), "root"))
    linked = stored(joined.unionByName(alone), "linked-classes")
    discard(rest, sets, ranked, prefix, centres, tried, mixed, own, roots)
    return linked


def _linked(pairs: DataFrame, ranked: DataFrame, num: int, den: int) -> DataFrame:
    """The verified ones among candidate pairs (a, b)."""
    side = lambda s: ranked.select(F.col("cls").alias(s), F.col("n").alias(f"n{s}"),
                                   F.col("grams").alias(f"g{s}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ga", "gb")
            .mapInArrow(_verify(num, den), "a binary, b binary"))


def keep_first(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without near duplicates: of each component the rows of the smallest
    doc_id stay (rows that repeat it with an equal set are the same document; with
    several sets of that doc_id in a component, one set stays).  Rows that share a
    doc_id but not the set are judged each by its own; rows without a doc_id stay.
    Column names and order are kept."""
    table, named = _described(docs, words, num, den)
    first = (named.where("doc_id IS NOT NULL").groupBy("root")
             .agg(F.min(F.struct("doc_id", "cls")).alias("first")))
    first = stored(named.select("cls", "root").join(first, "root").select("cls", "first"), "first-of-class")
    doc, cls = free_name("doc", docs.columns), free_name("cls", docs.columns)
    # made distinct before the join: after it nothing needs the copies of a text together, so
    # that the join can split a hot one
    members = table.where("doc_id IS NOT NULL AND cls IS NOT NULL").select("doc_id", "cls").distinct()
    gone = members.join(first, "cls").where("doc_id <> first.doc_id OR cls <> first.cls")
    gone = stored(gone.select(F.col("doc_id").alias(doc), F.col("cls").alias(cls)), "near-duplicates")
    some, rest = split_by_keys(docs, gone.withColumnRenamed(doc, "doc_id"), "doc_id")

    @F.pandas_udf("binary")
    def class_by_text(text):
        return pd.Series([class_of(s) for s in shingle_sets(pa.array(text, pa.string(), from_pandas=True), words)],
                         dtype=object)

    some = some.select("*", F.col("doc_id").cast("long").alias(doc), class_by_text("text").alias(cls))
    return rest.unionByName(some.join(gone, [doc, cls], "left_anti").select(*docs.columns))
