"""Ordered folds that stay parallel when one key holds most of the rows."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .state import cut

CHUNK_ROWS = 50_000
FOLD_WIDTH = 1024


def scan_in_order(
    rows: DataFrame, keys: list[str], order: list[str], step: Callable[[dict, dict], dict], out_schema: str,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Run ``step(state, row) -> output row`` over each key's rows in order.

    ``state`` is a small JSON-able dict the step may change (it starts empty for
    every key).  Rows are range-partitioned by (key, order), so a hot key spreads
    over many chunks and each task holds one bounded chunk.  All chunks run at
    once from an empty state; a chunk that continues its predecessor's key runs
    again with the predecessor's closing state until no opening state changes.
    That is exact, and because a state only remembers a few rows it settles after
    few rounds.
    """
    n = max(1, math.ceil(rows.count() / chunk_rows))
    placed = cut(rows.repartitionByRange(n, *keys, *order).withColumn("chunk", F.spark_partition_id()))
    out = T._parse_datatype_string(out_schema)
    fields = [f.name for f in out.fields]
    schema = T.StructType(
        [T.StructField("chunk", T.IntegerType()), T.StructField("first_key", T.StringType()),
         T.StructField("last_key", T.StringType()), T.StructField("state", T.StringType())] + out.fields
    )

    def run(chunk: pd.DataFrame, opening: pd.DataFrame) -> pd.DataFrame:
        if len(chunk) == 0:
            return pd.DataFrame(columns=[f.name for f in schema.fields])
        chunk = chunk.sort_values(keys + order, kind="stable")
        key_of = [json.dumps([str(v) for v in k]) for k in zip(*[chunk[c] for c in keys])]
        current = key_of[0]
        state = json.loads(opening["opening"].iloc[0]) if len(opening) else {}
        result = []
        names = list(chunk.columns)
        for key, values in zip(key_of, chunk.itertuples(index=False, name=None)):
            if key != current:
                current, state = key, {}
            result.append(step(state, dict(zip(names, values))))
        body = pd.DataFrame(result, columns=fields)
        number = int(chunk["chunk"].iloc[0])
        closing = pd.DataFrame([{"chunk": number, "first_key": key_of[0], "last_key": current, "state": json.dumps(state)}])
        return pd.concat([closing, body.assign(chunk=number)], ignore_index=True)[[f.name for f in schema.fields]]

    def pass_over(chunks: DataFrame, openings: DataFrame) -> DataFrame:
        return cut(chunks.groupBy("chunk").cogroup(openings.groupBy("chunk")).applyInPandas(run, schema))

    openings = rows.sparkSession.createDataFrame([], "chunk int, opening string")
    done = pass_over(placed, openings)
    while n > 1:
        ends = done.where("last_key IS NOT NULL").select("chunk", "first_key", "last_key", "state")
        w = Window.orderBy("chunk")  # one row per chunk
        wanted = ends.select(
            "chunk", F.when(F.lag("last_key").over(w) == F.col("first_key"), F.lag("state").over(w)).alias("opening")
        ).where("opening IS NOT NULL")
        changed = cut(wanted.join(openings.withColumnRenamed("opening", "was"), "chunk", "left").where(
            F.col("was").isNull() | (F.col("was") != F.col("opening"))).select("chunk", "opening"))
        if changed.isEmpty():
            break
        again = pass_over(placed.join(changed.select("chunk"), "chunk", "left_semi"), changed)
        done = cut(done.join(changed.select("chunk"), "chunk", "left_anti").unionByName(again))
        openings = cut(openings.join(changed.select("chunk"), "chunk", "left_anti").unionByName(changed))
    return done.where("last_key IS NULL").select(*fields)


def dense_positions(rows: DataFrame, keys: list[str], seq: str, name: str) -> DataFrame:
    """Rows with a number that grows with (keys, seq) and has no gaps within a task, however far apart ``seq`` values are.

    Rows are range-partitioned, so a hot key spreads over tasks, sorted, and numbered where they lie: (task, place).
    """
    placed = rows.repartitionByRange(*keys, seq).sortWithinPartitions(*keys, seq)
    return cut(placed.withColumn(name, F.monotonically_increasing_id()))


def clamped_sum(rows: DataFrame, keys: list[str], seq: str, delta: str, low: float, high: float,
                levels: int = 5, width: int = FOLD_WIDTH) -> DataFrame:
    """Ordered running sum clamped to [low, high] after every step; final value per key.

    A clamped addition is x -> min(hi, max(lo, x + d)).  Two of them in a row are
    again of that form, so the fold is associative: blocks of ``width`` neighbouring
    rows combine on their own and blocks of blocks follow.  Blocks are cut by places
    in sorted tasks, not by sequence numbers, so sparse ones make no difference: a list
    holds ``width`` entries at most, the last one an entry per ``width ** (levels - 1)``
    places of a key's tasks.
    """
    parts = rows.select(*keys, F.col(seq).cast("bigint").alias("_seq"), F.col(delta).cast("double").alias("d"))
    parts = dense_positions(parts, keys, "_seq", "_pos").select(
        *keys, "_pos", "d", F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"),
    )

    def then(f: Column, g: Column) -> Column:
        """f first, g second."""
        bound = lambda x: F.least(g["hi"], F.greatest(g["lo"], x + g["d"]))
        return F.struct((f["d"] + g["d"]).alias("d"), bound(f["lo"]).alias("lo"), bound(f["hi"]).alias("hi"))

    start = F.struct(F.lit(0.0).alias("d"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    for level in range(levels):
        block = F.floor(F.col("_pos") / F.lit(width)) if level < levels - 1 else F.lit(0).cast("bigint")
        parts = (
            parts.groupBy(*keys, block.alias("_block"))
            .agg(F.array_sort(F.collect_list(F.struct("_pos", "d", "lo", "hi"))).alias("steps"))
            .select(*keys, F.col("_block").alias("_pos"), F.aggregate("steps", start, then).alias("f"))
            .select(*keys, "_pos", "f.d", "f.lo", "f.hi")
        )
    value = F.least(F.col("hi"), F.greatest(F.col("lo"), F.col("d")))
    return parts.select(*keys, value.alias("value"))
