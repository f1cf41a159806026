"""Blocking keys of set similarity, refined where blocks are large.

Tokens of a set are ordered from rare to frequent, in one order for all sets.  If two sets share at least ``k`` tokens, their ``d``-th
shared one (``d <= k``) is within the first ``n - k + d`` tokens of a set of ``n``.  So such sets share a key made of their first ``d``
shared tokens, for every depth ``d``: a block may be parted by one more token at any time and loses no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a key row besides ``ord``, ``key``, ``size`` (tokens of the set) and the optional ``passive``: place of the last token (from 1), tokens in the key,
#: shared tokens that the row counts on, and whether the row cannot be parted further.
PLACE = ["pos", "depth", "need", "fixed"]
#: Columns of the rows that `first_keys` makes.
ROW = ["ord", "size", "key", *PLACE]


def compact(tokens: Column) -> Column:
    """Tokens as 64-bit hashes: what is compared pair by pair, at half the size and less."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def within_reach(shared: Column, a, b) -> Column:
    """Whether two sets may share ``shared`` tokens if the key holds the first ones they share: what lies behind its place must do."""
    rest = F.least(a("size") - a("pos"), b("size") - b("pos"))
    return a("depth") + rest >= shared


def ranked(sets: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``ord``, ``n`` and ``r``: each set's tokens from rare to frequent (ties by the token)."""
    tok = sets.select("ord", F.size(tokens).alias("n"), F.explode(tokens).alias("token"))
    freq = tok.groupBy("token").agg(F.count("*").alias("df"))
    lists = tok.join(freq, "token").groupBy("ord", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r"))
    return lists.select("ord", "n", F.transform("r", lambda x: x["token"]).alias("r"))


def first_keys(rows: DataFrame, need: Column, prefix: Column) -> DataFrame:
    """Key rows of depth 1 of sets that count on ``need`` shared tokens: one per token among the first ``n - need + 1``.

    ``rows``: ord, n, r and any columns to keep; ``prefix`` begins every key.
    """
    kept = [c for c in rows.columns if c not in ("n", "r")]
    heads = rows.withColumn("need", need.cast("int")).where("n >= need").select(
        *kept, F.col("n").alias("size"), "need", F.posexplode(F.expr("slice(r, 1, n - need + 1)")).alias("at", "token"))
    return heads.select(*kept, "size", F.xxhash64(prefix, "token").alias("key"), (F.col("at") + 1).alias("pos"), F.lit(1).alias("depth"), "need", (F.col("need") <= 1).alias("fixed"))


def deeper(order: DataFrame):
    """A split: rows of a block go on to the next shared token, so far as they count on one.

    ``order``: ord, n, r of all sets.  Rows of one block have one depth.  Sets that count on fewer tokens than a part has would miss
    it; they stay, as a block of their own together with the sets that may be similar to them, whose rows have ``near`` true.
    """

    def split(rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if c not in ("key", *PLACE)]
        full = rows.join(order, "ord")
        parts = full.where("need > depth").select(
            *kept, "key", "depth", "need", "pos",
            F.posexplode(F.expr("slice(r, pos + 1, greatest(least(n - need + depth + 1, n) - pos, 0))")).alias("at", "token"))
        parts = parts.select(
            *kept, F.xxhash64("key", "token").alias("key"), (F.col("pos") + F.col("at") + 1).alias("pos"), (F.col("depth") + 1).alias("depth"), "need",
            (F.col("need") <= F.col("depth") + 1).alias("fixed"))
        short = full.where("need <= depth OR near <= depth").select(
            *kept, F.xxhash64("key", F.lit("=")).alias("key"), "pos", "depth", "need", F.lit(True).alias("fixed"))
        return parts.unionByName(short)

    return split
