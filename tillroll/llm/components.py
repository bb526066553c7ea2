"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.shared import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (columns a, b; any orderable type):
    root is the smallest id reachable.  Null ends and self links are left out.

    Each round points larger neighbours at the smallest one (large star), then
    parents of one node at its smallest parent (small star).  A node's
    neighbours are never gathered: minima are map-side combined and joined back
    (a hot node is a skewed join, which AQE splits).  The edge table is stored
    in the shared folder each round; rounds grow with the logarithm of the
    longest path.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = stored(ends.select(F.greatest("a", "b").alias("u"),
                               F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u")
                 .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
                         .alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        last, edges = edges, stored(small, "edges")
        discard(last)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]
