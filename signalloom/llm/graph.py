"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b: long): root is the smallest node that it can reach.

    Alternating large and small stars: each node hands its neighbours over to the smallest one, as minimum aggregates
    and joins, so a node with very many neighbours is never gathered.  Every round is written to the shared folder, and the
    loop ends when a round changes no edge; the number of rounds grows with the logarithm of the longest path.
    """
    e = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(e)
    for _ in range(max_rounds):
        e = keep(_small_star(_large_star(e)), "edges")
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to the smallest of its neighbours and itself."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, go to the smallest of them."""
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
