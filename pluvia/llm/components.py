"""Connected components of a large graph by alternating large-star and small-star steps.

Each step is an aggregate (combined map-side) and a join, so a node with very many neighbours is no group in memory;
the number of edges never grows, and a logarithmic number of rounds is expected.  Every round is written and read
again, which keeps the plan short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions.storage import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m"))
    joined = both.join(least, F.col("a") == F.col("_a")).filter("b > a")
    return joined.select(F.col("b").alias("a"), F.least("_m", "a").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m"))
    to_least = edges.join(least, F.col("a") == F.col("_a")).filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return to_least.union(least.select("_a", "_m")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the ends of the edges (a, b), long columns; root: the smallest node reachable.

    Loops and repeated edges do no harm; a null end is left out.  Nodes without an edge are not listed.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialise(edges), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == before or not now[0]:
            break
        before = tuple(now)
        edges = materialise(_small_star(_large_star(edges)))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
