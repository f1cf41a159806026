"""Sharding by a permutation of global row numbers, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex_number, text_key

ROUNDS = 8
#: Steps of cycle walking.  At most about sqrt(n) of the numbers lie outside, so more than a few steps
#: in a row are out of reach for large n, and the number of outside values bounds them for small n.
WALK = 64


def _times(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def _once(x: Column, a: Column, b: Column, seed: str, rounds: int) -> Column:
    """One pass of the network over [0, a*b): the halves are x div b and x mod b."""
    def step(s: Column, i: Column) -> Column:
        def noise(v: Column) -> Column:
            return hex_number(F.concat_ws("|", F.lit(seed), i.cast("string"), v.cast("string")), 12)

        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + noise(s["r"])) % a).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + noise(s["l"])) % b).alias("r"),
        )

    whole = F.floor(x / b)
    start = F.struct(whole.cast("long").alias("l"), (x % b).cast("long").alias("r"))
    return F.aggregate(_times(rounds), start, step, lambda s: s["l"] * b + s["r"])


def permuted(x: Column, n: Column, seed: str = "shuffle", rounds: int = ROUNDS) -> Column:
    """Where the seeded shuffle of [0, n) puts ``x``: computable from ``x`` and ``n`` alone."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")
    out = F.aggregate(
        _times(WALK), _once(x, a, b, seed, rounds), lambda s, _: F.when(s < n, s).otherwise(_once(s, a, b, seed, rounds)),
    )
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("cycle walking did not end")))


def row_numbers(df: DataFrame, key: Column, tie: Column, buckets: int = 4096) -> DataFrame:
    """Add ``row_number`` (0 to rows - 1) and ``n_rows``, reproducible and without one global sort.

    Rows are spread over ``buckets`` by a hash of key and tie; a bucket's offset is the number of rows in the
    buckets before it.  One task numbers a bucket, another adds up ``buckets`` counts.
    """
    rows = df.select(F.struct("*").alias("_row"), text_key(key).alias("_key"), tie.alias("_tie"))
    rows = rows.withColumn("_bucket", hex_number(F.concat_ws("|", "_key", F.col("_tie").cast("string")), 8) % buckets)
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    order = Window.orderBy("_bucket")
    offsets = counts.select(
        "_bucket", (F.sum("_n").over(order) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"),
    )
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", "_tie"))
    numbered = rows.withColumn("_within", within).join(offsets, "_bucket")
    kept = [c for c in df.columns if c.lower() not in ("row_number", "n_rows")]
    return numbered.select(
        *[F.col("_row")[c].alias(c) for c in kept], (F.col("_before") + F.col("_within") - 1).alias("row_number"), F.col("_all").alias("n_rows"),
    )


def shard(df: DataFrame, key: Column, tie: Column, shards: int = 16, seed: str = "shuffle", buckets: int = 4096) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    The shuffled row number p goes to shard ``p mod shards``, slot ``p div shards``: shard sizes differ by one
    row at most (law ``rows``), whatever the texts or keys are.  Null keys and equal rows are ordinary rows; rows
    equal in key and tie are interchangeable.  An empty table gives an empty result; columns of the result's own
    names (row_number, n_rows, shard, slot) are replaced.
    """
    numbered = row_numbers(df, key, tie, buckets)
    placed = numbered.withColumn("_p", permuted(F.col("row_number"), F.col("n_rows"), seed))
    return placed.withColumn("shard", (F.col("_p") % shards).cast("int")).withColumn("slot", F.floor(F.col("_p") / shards).cast("long")).drop("_p")
