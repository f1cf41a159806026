"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex_number, keep, kept_columns, text_key

WEIGHTS = (5, 2, 1)
#: Expected copies are counted in this fraction of a copy, so that positions are exact whole numbers.
UNIT = 1 << 24


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = 3) -> DataFrame:
    """Add ``target`` to (source, source_size): the share of all sizes that each source gets.

    Sources in code point order, null last, weigh ``weights`` in turn.  No target is above ``cap`` times the
    source's size; the excess goes to the others by weight.  With sources ordered by cap over weight, those at
    their cap are a prefix, and the level of the rest is what is left over their weights.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (pick + 1).cast("int"))
    s = sources.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * cap)
    line = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
    s = s.withColumn("_weights", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    # The first source whose cap is above the level, and so are all behind it.
    s = s.withColumn("_free", F.col("_cap") * F.col("_weights") >= F.col("_left") * F.col("_w"))
    s = s.withColumn("_num", F.max(F.when(F.col("_free"), F.struct(-F.col("_cap") / F.col("_w"), F.col("_weights"), F.col("_left")))).over(everything))
    level = F.col("_w") * F.col("_num")["_left"] / F.col("_num")["_weights"]
    target = F.least(F.col("_cap").cast("double"), F.coalesce(level, F.col("_cap").cast("double")))
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, size: Column, tie: Column, weights=WEIGHTS, cap: int = 3, seed: str = "mix", buckets: int = 4096,
) -> DataFrame:
    """Add size, source_size, target, copies and taken (copies * size) to every row of ``docs`` (doc_id, source).

    Each row's expected copies are its source's target over its source's size, ``cap`` at most.  Within a source
    the rows lie on a line in the order of size, hashed bucket, doc_id and ``tie``; a row covers as much of the line as its
    expected copies, and with one random offset per source it is taken once for every whole number it crosses.
    Rows of like size are neighbours, so the taken size misses the target by little more than the largest row.

    The line is never sorted as a whole: counts by (source, size) and by (source, size, bucket) give each bucket its
    start, and a task numbers the rows of a bucket only, so neither a hot source nor a hot size meets in one task.
    Null sources are a source of their own, null sizes count 0, rows of size 0 are taken with size 0; equal rows are
    rows of their own.  An empty table gives an empty result; columns with the names of results are replaced.
    """
    rows = docs.select(
        F.struct("*").alias("_row"), text_key(F.col("source")).alias("_key"), F.coalesce(size.cast("long"), F.lit(0)).alias("_size"),
        (hex_number(text_key(F.col("doc_id")), 8) % buckets).alias("_bucket"), tie.alias("_tie"),
    )
    cells = keep(rows.groupBy("_key", "_size", "_bucket").agg(F.count("*").alias("_n")), "mix-counts")
    in_size = Window.partitionBy("_key", "_size").orderBy("_bucket")
    starts = cells.withColumn("_at", F.sum("_n").over(in_size) - F.col("_n"))
    sizes = cells.groupBy("_key", "_size").agg(F.sum("_n").alias("_m"))
    sizes = sizes.withColumn("_from", F.sum("_m").over(Window.partitionBy("_key").orderBy("_size")) - F.col("_m")).drop("_m")
    totals = sizes_by_source(cells)
    goal = targets(totals, weights, cap).withColumn("_key", text_key(F.col("source"))).drop("source")
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("_rate", rate).withColumn("_offset", hex_number(F.concat_ws("|", F.lit(seed), "_key"), 6))
    # One small table says where each cell starts; cells are few against rows, or as small as they.
    cell = starts.join(sizes, ["_key", "_size"]).join(goal, "_key").drop("_n")
    n = F.row_number().over(Window.partitionBy("_key", "_size", "_bucket").orderBy(F.col("_row")["doc_id"], "_tie"))
    placed = rows.withColumn("_i", n).join(cell, ["_key", "_size", "_bucket"])
    end = F.col("_offset") + (F.col("_from") + F.col("_at") + F.col("_i")) * F.col("_rate")
    copies = F.expr("{} div {}".format("_end", UNIT)) - F.expr(f"(_end - _rate) div {UNIT}")
    placed = placed.withColumn("_end", end).withColumn("_copies", copies)
    kept = kept_columns(docs, ("size", "source_size", "target", "copies", "taken"))
    return placed.select(
        *[F.col("_row")[c].alias(c) for c in kept], F.col("_size").alias("size"), "source_size", "target",
        F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def sizes_by_source(cells: DataFrame) -> DataFrame:
    source = F.when(F.substring("_key", 1, 1) == "s", F.expr("substring(_key, 2)"))
    return cells.groupBy("_key").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size")).select(source.alias("source"), "source_size")


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as it was taken."""
    return mixed.filter("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")
