"""A Merkle manifest of a table: digests of rows, trees by group, one root, and proofs.

Every row is a leaf.  The leaves of a group, in order, are hashed by runs of ``FAN``
until one node remains, its subroot; the subroots, in order of the group, likewise
give the root.  A node is stored as a row with the digests of its children and the
place of its parent.  A proof is made by ascending: a recursive query joins rows with their
parents', appends the siblings found there, folds the digest of every (possibly
tampered) leaf, and goes on from the parent's own parent.  The leaves of one run have the same
siblings above it, so they ascend in one row: every round of a recursive query shuffles
its rows, and with a row for each leaf that is 3.6 times the corpus (0.51 GB).

No group meets in one task: places of leaves come from counts of sorted ranges, a run
has at most ``FAN`` rows, and the nodes near the root, which all leaves ascend through,
are at most ``TOP_NODES`` rows and broadcast; of the ascent below them, at most ``FAN`` to the
power of its levels meets in one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.shared import discard, positions, stored, tune

#: Children of a node; nodes (and bytes of them) that are broadcast.
FAN, TOP_NODES, TOP_BYTES = 8, 1 << 16, 1 << 26
#: The tree of the subroots (trees of groups are named "" for null, or "=" and the group).
TOP = "/"
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SETTINGS = {"spark.sql.cteRecursionRowLimit": "-1"}


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def as_text(binary: Column | str) -> Column:
    """Digests as lower-case hex text."""
    return F.lower(F.hex(binary))


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its length in bytes, ``:``, itself."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, tampered) of every row: the digest as it is, and with A-Z of the
    text lower-cased where 3 divides the CRC-32 of the decimal doc_id (else null)."""
    ids = F.col("doc_id").cast("long")
    head = [field(ids), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars"))]
    lower = F.translate("text", _AZ, _AZ.lower())
    hit = F.crc32(ids.cast("string").cast("binary")) % 3 == 0
    return docs.select(
        ids.alias("doc_id"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"),
        digest(*head, field(F.col("text"))).alias("leaf"),
        F.when(hit, digest(*head, field(lower))).alias("tampered"))


def _parent(tree: str, level: str, pos: str) -> list[Column]:
    """Place of the parent, and which of its children the node is."""
    return [F.col(tree).alias("up_tree"), (F.col(level) + 1).alias("up_level"),
            F.expr(f"{pos} div {FAN}").alias("up_pos"), F.expr(f"CAST({pos} % {FAN} AS INT)").alias("slot")]


def first_runs(placed: DataFrame) -> DataFrame:
    """Level 1 of the trees over ``placed`` leaves: (tree, pos, size, kids, hash, members), of
    which members are the leaves' doc_id and the digest folded from what stands in for each
    (a leaf that is alone in its tree is the node itself)."""
    runs = (placed.groupBy("tree", F.expr(f"pos div {FAN}").alias("at"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", "leaf", "doc_id", "tampered"))).alias("run"),
                 F.max("size").alias("leaves")))
    kids = F.aggregate("run", F.lit(b""), lambda all_, kid: F.concat(all_, kid["leaf"]))
    runs = runs.select("tree", F.lit(1).alias("level"), F.col("at").alias("pos"), "leaves", "run", kids.alias("kids"),
                       F.expr(f"(leaves + {FAN - 1}) div {FAN}").alias("size"))

    def folded(kid: Column, slot: Column) -> Column:
        own = F.coalesce(kid["tampered"], kid["leaf"])
        left = as_text(F.substring("kids", F.lit(1), 32 * slot))
        right = as_text(F.substring("kids", 32 * slot + 33, F.lit(32 * FAN)))
        return F.struct(kid["doc_id"].alias("doc_id"), F.when(F.col("leaves") == 1, own).otherwise(
            digest(left, as_text(own), right)).alias("folded"))

    return runs.select("tree", "level", "pos", "size", "kids", F.transform("run", folded).alias("members"),
                       F.when(F.col("leaves") == 1, F.col("kids")).otherwise(digest(as_text("kids"))).alias("hash"))


def build_levels(nodes: DataFrame, most: int, level: int) -> list[DataFrame]:
    """The levels from ``level`` on, above ``nodes`` (tree, pos, size: nodes of its level in the
    tree, hash), of trees of at most ``most`` of them: stored rows (tree, level, pos, size, hash,
    kids)."""
    out = []
    while most > 1:
        runs = (nodes.where("size > 1").groupBy("tree", F.expr(f"pos div {FAN}").alias("at"))
                .agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("kids"),
                     F.expr(f"max(size + {FAN - 1}) div {FAN}").alias("size")))
        kids = F.aggregate("kids", F.lit(b""), lambda all_, kid: F.concat(all_, kid["hash"]))
        runs = (runs.select("tree", F.lit(level).alias("level"), F.col("at").alias("pos"), "size", kids.alias("kids"))
                .withColumn("hash", digest(as_text("kids"))))
        nodes = stored(runs, f"level-{level}")
        out.append(nodes)
        most, level = -(-most // FAN), level + 1
    return out


def _ascend(spark: SparkSession, rows: DataFrame, nodes: DataFrame, hint: str, until: str) -> DataFrame:
    """The rows (climb) after ascending through ``nodes`` as far as ``until`` holds."""
    before = {k: spark.conf.get(k) for k in _SETTINGS}
    left, right = "substr(n.kids, 1, 32 * c.slot)", "substr(n.kids, 32 * c.slot + 33)"
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        return stored(spark.sql(f"""
            WITH RECURSIVE climb AS (
              SELECT members, kids, subroot, siblings, up_tree, up_level, up_pos, slot FROM {{rows}}
              UNION ALL
              SELECT {hint} transform(c.members, m -> named_struct('doc_id', m.doc_id, 'folded', unhex(sha2(
                       concat(lower(hex({left})), lower(hex(m.folded)), lower(hex({right}))), 256)))),
                     c.kids, coalesce(c.subroot, n.subroot), concat(c.siblings, {left}, {right}),
                     n.up_tree, n.up_level, n.up_pos, n.slot
              FROM climb c JOIN {{nodes}} n
                ON n.tree = c.up_tree AND n.level = c.up_level AND n.pos = c.up_pos)
            SELECT * FROM climb WHERE {until}""", rows=rows, nodes=nodes), "climbed")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def manifest(docs: DataFrame, top_nodes: int = TOP_NODES) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of
    ``docs`` (doc_id, source, lang, n_chars, text; other columns are ignored).

    Digests are lower-case hex.  Leaves of a lang ascend by doc_id (null first; of equal
    ones by their digest), langs by their bytes (null first).  proof_sha256 is the digest
    of the siblings' hex text, level by level, left to right (a table of one row has none:
    that of the empty text).  A row without a doc_id is never tampered with.  Repeated rows
    are leaves each.  An empty table gives an empty result.
    """
    spark = tune(docs.sparkSession)
    rows = stored(leaves(docs), "leaves")
    placed = stored(positions(rows, ["tree"], [F.asc("doc_id"), F.asc("leaf")], total="size"), "placed-leaves")
    first = stored(first_runs(placed), "level-1")
    most, widest = first.agg(F.coalesce(F.max("size"), F.lit(0)), F.max(F.octet_length("tree"))).first()
    levels = [first, *build_levels(first, most, 2)]

    tops = None
    for level in levels:
        some = level.where("size = 1").select("tree", "hash")
        tops = some if tops is None else tops.unionByName(some)
    ranked = stored(positions(stored(tops, "subroots"), [], [F.asc("tree")], total="size"), "ranked-subroots")
    trees = ranked.count()
    upper = build_levels(ranked.select(F.lit(TOP).alias("tree"), "pos", "size", "hash"), trees, 1)
    root = (upper[-1] if upper else ranked).select(as_text("hash")).first()
    root = F.lit(root[0] if root else None).cast("string")

    # what stands above a subroot: nothing if it is the root, else a run of subroots
    above = ranked.select(F.col("tree"), F.lit(TOP).alias("top"), F.lit(0).alias("bottom"), "pos", "size")
    above = above.select("tree", *(F.when(F.col("size") > 1, c).alias(c_) for c, c_ in zip(
        _parent("top", "bottom", "pos"), ("up_tree", "up_level", "up_pos", "slot"))))
    links = ["tree", "level", "pos", "kids", "subroot", "up_tree", "up_level", "up_pos", "slot"]
    none = F.lit(None).cast("binary")

    def linked(nodes: DataFrame, columns: list[str]) -> DataFrame:
        """Nodes of trees of groups with the place of their parent."""
        inner = nodes.where("size > 1").select("*", *_parent("tree", "level", "pos")).withColumn("subroot", none)
        tip = nodes.where("size = 1").join(above, "tree").withColumn("subroot", F.col("hash"))
        return inner.select(*columns).unionByName(tip.select(*columns))

    held = {(0, k): linked(n, links) for k, n in enumerate(levels, 1) if k > 1}
    for k, n in enumerate(upper, 1):
        parent = [F.when(F.col("size") > 1, c).alias(c_) for c, c_ in zip(
            _parent("tree", "level", "pos"), ("up_tree", "up_level", "up_pos", "slot"))]
        held[1, k] = n.select("*", *parent).withColumn("subroot", none).select(*links)

    start = linked(first, ["members", *links]).drop("tree", "level", "pos").withColumn("siblings", F.lit(b""))

    # the nodes near the root, as many levels as may be broadcast, and those below them
    sizes = [n.count() for n in levels]
    split, near = len(levels), sum(n.count() for n in upper)
    fits = near <= top_nodes
    while split > 1 and near + sizes[split - 1] <= min(top_nodes, TOP_BYTES // (400 + 2 * (widest or 0))):
        split, near = split - 1, near + sizes[split - 1]

    def union(keys) -> DataFrame | None:
        out = None
        for k in keys:
            out = held[k] if out is None else out.unionByName(held[k])
        return out

    climbed = start
    if split > 1:
        below = stored(union([k for k in held if k[0] == 0 and k[1] <= split]), "lower-nodes")
        climbed = _ascend(spark, stored(climbed, "climb"), below, "",
                          f"up_tree IS NULL OR up_tree = '{TOP}' OR up_level > {split}")
    if near:
        nodes = stored(union([k for k in held if k[0] == 1 or k[1] > split]), "upper-nodes")
        climbed = _ascend(spark, stored(climbed, "climb"), nodes, "/*+ BROADCAST(n) */" if fits else "", "up_tree IS NULL")
    discard(rows, placed)
    leaf = F.substring("kids", 32 * F.col("i") + 1, F.lit(32))
    own = F.concat(F.substring("kids", F.lit(1), 32 * F.col("i")), F.substring("kids", 32 * F.col("i") + 33, F.lit(32 * FAN)))
    out = climbed.select("kids", "subroot", "siblings", F.posexplode("members").alias("i", "m"))
    return out.select(
        F.col("m.doc_id").alias("doc_id"), as_text(leaf).alias("leaf"), as_text("subroot").alias("subroot"),
        root.alias("root"), F.sha2(as_text(F.concat(own, "siblings")).cast("binary"), 256).alias("proof_sha256"),
        as_text("m.folded").alias("folded_root"), (as_text("m.folded") == root).alias("verified"))
