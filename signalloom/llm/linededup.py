"""Line deduplication by a deletion-neighbourhood join, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, keep, kept_columns

#: The edit bound of this operator: an inserted, deleted or replaced character.
EDITS = 1


def _lines(docs: DataFrame) -> DataFrame:
    """(at, k1, k2, line) of every line with a word; ``at`` orders lines by document (null doc_id last) and place."""
    text = F.col("text")
    d = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    d = d.filter(F.col("line").rlike(WORD))
    at = F.struct(F.col("doc").isNull().alias("none"), "doc", "th", "pos")
    return d.select(at.alias("at"), F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(7), "line").alias("k2"), "line")


def _halves(line: Column, size: Column) -> Column:
    """Four (flag, key): the first and last half of the line, as member of the length class of its own size and of the next.

    Two lines within one edit, the longer of ``m`` characters, agree in the first h or in the last m - 1 - h characters for any h: what they
    have in common at both ends is m - 1 characters at least.  So they share one of these keys.
    """
    def key(flag: int, m: Column) -> Column:
        h = F.floor((m - 1) / 2).cast("int")
        part = F.substring(line, 1, h) if flag < 2 else F.right(line, m - 1 - h)
        return F.struct(F.lit(flag).alias("flag"), F.xxhash64(m, F.lit(flag < 2), part).alias("hk"))

    return F.array(*[key(flag, size + flag % 2) for flag in range(4)])


def _variants(flagged: DataFrame) -> DataFrame:
    """(vk, pos, id): hashed deletion variants of flagged lines.

    In the class of its own length a line gives every variant with one character of its other half deleted; in the class above,
    where it is the shorter one, it gives itself (pos -1).
    """
    longer = F.col("flag") % 2 == 0
    m = F.col("size") + F.col("flag") % 2
    h = F.floor((m - 1) / 2).cast("int")
    first = F.col("flag") < 2
    f = flagged.withColumn("m", m).withColumn("rest", F.when(first, F.expr("substring(line, cast(floor((m - 1) / 2) as int) + 1)")).otherwise(F.expr("left(line, size - (m - 1 - cast(floor((m - 1) / 2) as int)))")))
    f = f.withColumn("half", F.xxhash64("m", first, F.when(first, F.substring("line", 1, h)).otherwise(F.right(F.col("line"), F.col("m") - 1 - h))))
    places = F.when(longer, F.sequence(F.lit(1), F.length("rest"))).otherwise(F.array(F.lit(0)))
    f = f.select("id", "half", "rest", F.explode(places).alias("p"))
    variant = F.when(F.col("p") == 0, F.col("rest")).otherwise(F.expr("concat(left(rest, p - 1), substring(rest, p + 1))"))
    return f.select(F.xxhash64("half", variant).alias("vk"), (F.col("p") - 1).alias("pos"), "id")


def _maybe(rows: DataFrame, wanted: DataFrame, key: str, bits: int = 1 << 23) -> DataFrame:
    """``rows`` without most of those whose key is not in ``wanted``: a bitmap of ``bits`` hashed keys (1 MB, whatever the input) goes to
    all tasks.  With more wanted keys than bits it lets all rows pass, and the join behind it decides as before."""
    slot = lambda: F.pmod(F.xxhash64(F.lit(11), key), F.lit(bits)) + 1
    maps = wanted.select(slot().alias("s")).groupBy(F.bitmap_bucket_number("s").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("_map"))
    at = F.bitmap_bit_position(slot())
    byte = F.conv(F.hex(F.substring("_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1") == 1
    held = rows.withColumn("_bucket", F.bitmap_bucket_number(slot())).join(F.broadcast(maps), "_bucket")
    return held.withColumn("_byte", byte).withColumn("_at", at).filter(found).select(*rows.columns)


def near_lines(distinct: DataFrame, lines: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2) of distinct lines that have an earlier line within one edit.

    Only lines that share a half with another line can have one; they alone give variants.  Lines of one length that share variant and
    place differ in that character only; a line and one that equals its variant differ by that character.  So the earliest line of
    each group settles its members: as many pairs as rows, whatever the size of a group.  Pairs are verified by edit distance.
    """
    halves = distinct.filter(F.col("size") >= min_chars).select("k1", "k2", F.explode("halves").alias("x")).select("k1", "k2", "x.*")
    shared = halves.groupBy("hk").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).filter("low < high").select("hk")
    flags = halves.join(shared, "hk", "left_semi").groupBy("k1", "k2").agg(F.collect_set("flag").alias("flags"))
    flags = keep(flags, "flagged")
    texts = _maybe(lines, flags, "k1").join(flags, ["k1", "k2"]).groupBy("k1", "k2").agg(F.min("at").alias("at"), F.first("flags").alias("flags"), F.first("line").alias("line"))
    # Ids rise with the lines' first places: they are given to a sorted table as it is written.
    nodes = keep(texts.orderBy("at").withColumn("id", F.monotonically_increasing_id()).withColumn("size", F.length("line")), "flagged-lines")
    v = _variants(nodes.select("id", "line", "size", F.explode("flags").alias("flag")))
    v = keep(v, "variants")
    long, short = v.filter("pos >= 0"), v.filter("pos < 0")
    alike = long.groupBy("vk", "pos").agg(F.min("id").alias("y"), F.max("id").alias("z")).filter("y < z").select("vk", "pos", "y")
    cross = short.groupBy("vk").agg(F.min("id").alias("s")).join(long.groupBy("vk").agg(F.min("id").alias("l")), "vk")
    pairs = long.join(alike, ["vk", "pos"]).filter("id > y").select(F.col("id").alias("x"), "y")
    pairs = pairs.unionByName(cross.filter("l < s").select(F.col("s").alias("x"), F.col("l").alias("y")))
    pairs = pairs.unionByName(long.join(cross, "vk").filter("id > s").select(F.col("id").alias("x"), F.col("s").alias("y"))).distinct()
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}"), "k1", "k2")
    both = pairs.join(side("x"), "x").join(side("y").drop("k1", "k2"), "y")
    return both.filter(F.levenshtein("line_x", "line_y", EDITS) >= 0).select("k1", "k2").distinct()


def dedup_lines(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_key, n_lines, removed (places, from 0, of the lines to take out).

    Lines are what line feeds separate.  A line with a word goes if an earlier line of any document, or of its own, equals it or (for
    lines of at least ``min_chars`` characters) lies within one inserted, deleted or replaced character; lines are judged on the input.
    Earlier means a smaller doc_id (null last), then an earlier place.  Lines without a word stay.

    A null text has no lines.  Rows equal in doc_id and text are one document and get equal results; rows with one doc_id and different
    texts are ordered by a hash of the text.  An empty table gives an empty result; other columns are left out.
    """
    lines = _lines(docs)
    sized = lines.withColumn("size", F.length("line")).withColumn("halves", _halves(F.col("line"), F.col("size")))
    distinct = sized.groupBy("k1", "k2", "size", "halves").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    distinct = keep(distinct, "lines")
    near = near_lines(distinct, lines, min_chars).withColumn("near", F.lit(True))
    verdicts = distinct.select("k1", "k2", "first", "n").join(near, ["k1", "k2"], "left").filter("n > 1 or near")
    gone = lines.select("at", "k1", "k2").join(verdicts, ["k1", "k2"]).filter("near or at > first")
    removed = gone.groupBy(F.col("at.doc").alias("_doc"), F.col("at.th").alias("_th")).agg(F.sort_array(F.collect_set("at.pos")).alias("removed"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
        F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("long").alias("n_lines"),
    )
    same = rows["doc_id"].eqNullSafe(removed["_doc"]) & (rows["text_key"] == removed["_th"])
    return rows.join(removed, same, "left").select("doc_id", "text_key", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``."""
    r = removed.filter(F.size("removed") > 0).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_th"), "removed").dropDuplicates(["_doc", "_th"])
    d = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"))
    joined = d.join(r, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_th")), "left")
    text = F.expr("array_join(filter(split(_row.text, '\\n', -1), (x, i) -> not array_contains(removed, i)), '\\n')")
    text = F.when(F.col("removed").isNull(), F.col("_row.text")).otherwise(text)
    return joined.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in kept_columns(docs, ())])
