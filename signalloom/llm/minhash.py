"""Near duplicates: MinHash bands for candidates, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, keep, mix, n_tasks, pieces, randoms
from .graph import components

HASHES, BATCH = 128, 16
#: Chance to miss a pair at the threshold: in no band, and by pruning in any one comparison.
BAND_MISS, PRUNE_MISS = 1e-6, 1e-8
#: Members of a bucket, and shingles of theirs, that one task compares with as many others.
BLOCK, BLOCK_ITEMS = 1024, 1 << 20
_ODD = randoms(HASHES, 11) | np.uint64(1)


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles (ASCII letters lower-cased); fewer words are one shingle, none is none."""
    w = Words([t or b"" for t in texts], lower=True)
    counts = w.counts()
    ends, h = np.cumsum(counts), w.combined(width) if len(w.doc) >= width else np.zeros(0, np.uint64)
    out = []
    for n, end in zip(counts, ends):
        if n >= width:
            out.append(np.unique(h[end - n:end - width + 1]))
        elif n:
            few = np.uint64(n)
            for x in w.hash[end - n:end]:
                few = mix(np.array([few ^ x], np.uint64))[0]
            out.append(np.array([few], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures of sets that are not empty."""
    sizes = np.array([len(s) for s in sets])
    starts, h = np.cumsum(sizes) - sizes, np.concatenate(sets)
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((h * _ODD[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def bands(threshold: float) -> tuple[int, int]:
    """(bands, rows): the longest rows that still catch a pair at the threshold but for BAND_MISS."""
    for rows in range(16, 0, -1):
        n = HASHES // rows
        if (1 - threshold**rows) ** n <= BAND_MISS:
            return n, rows
    raise ValueError("threshold too low for this number of hashes")


def least_matches(threshold: float) -> np.ndarray:
    """After each batch of hashes: fewest matches with which the pair is not yet given up.

    With a uniform prior of the similarity, P(similarity >= t | m of n match) is P(Binomial(n + 1, t) <= m); a pair is given up where
    that is below PRUNE_MISS.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        for i in range(n + 2):
            total += np.exp(lgamma(n + 2) - lgamma(i + 1) - lgamma(n + 2 - i) + i * log(threshold) + (n + 1 - i) * log(1 - threshold))
            if total >= PRUNE_MISS:
                m = i
                break
        out.append(m)
    return np.array(out)


def promising(sig: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, per_cent: int, least: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of rows of ``sig`` may be similar: sizes first, then batch after batch of hashes."""
    left = np.flatnonzero(100 * np.minimum(n[i], n[j]) >= per_cent * np.maximum(n[i], n[j]))
    seen = np.zeros(len(left), np.int64)
    for k, m in enumerate(least):
        part = sig[:, k * BATCH:(k + 1) * BATCH]
        seen += (part[i[left]] == part[j[left]]).sum(1)
        ok = np.flatnonzero(seen >= m)
        left, seen = left[ok], seen[ok]
    return left


def _sign(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, k1, k2, sig): set size, 128-bit name of the set, signature; nulls for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            sets = shingle_sets(texts, width)
            full = [i for i, s in enumerate(sets) if len(s)]
            k1, k2, sig = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                for i, s in zip(full, signatures([sets[i] for i in full])):
                    k1[i], k2[i], sig[i] = *set_name(sets[i]), s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())],
                names=["doc_id", "n", "k1", "k2", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sig binary")


def set_name(s: np.ndarray) -> tuple[int, int]:
    a, b = mix(s ^ np.uint64(0x51ED)).sum(dtype=np.uint64), mix(s + np.uint64(0x2545F491)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _pruned(pairs: DataFrame, classes: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) of classes that the comparison of signatures does not give up."""
    least = least_matches(per_cent / 100)
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            sig = np.concatenate([_signatures(col[f"sig_{x}"]) for x in "ab"])
            n = np.concatenate([col[f"n_{x}"].to_numpy(zero_copy_only=False) for x in "ab"])
            i = np.arange(len(batch))
            left = pa.array(promising(sig, i, i + len(batch), n, per_cent, least))
            yield pa.RecordBatch.from_arrays([col["a"].take(left), col["b"].take(left)], names=["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            left = pa.array([i for i in range(len(batch)) if similar(x[i].as_py(), y[i].as_py(), per_cent)], pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(left), b.take(left)], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame) -> DataFrame:
    """Rows of (key, _x, _y): every two blocks of a bucket meet once, and so does each block with itself.

    A bucket is one block unless it has more than BLOCK members or BLOCK_ITEMS shingles; nothing is capped.
    """
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("weight") / BLOCK_ITEMS)).cast("int")
    m = members.withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    m = m.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return m.withColumn("_x", F.least("_block", "_other")).withColumn("_y", F.greatest("_block", "_other")).drop("_blocks", "_other")


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (key, _x, _y) out of batches that are sorted by group."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        key, x, y = (t.column(c).to_numpy() for c in ("key", "_x", "_y"))
        last = len(t) - int(np.argmin(((key == key[-1]) & (x == x[-1]) & (y == y[-1]))[::-1])) if len(t) else 0
        if len(t) and (key[0], x[0], y[0]) == (key[-1], x[-1], y[-1]):
            last = 0
        if last:
            yield t.slice(0, last)
        held = t.slice(last)
    if held is not None and len(held):
        yield held


def _block_pairs(t: pa.Table, least: np.ndarray, per_cent: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of promising pairs of rows in one group with different roots; a pair belongs to the first band that it shares.

    All rows are compared with the next row of their group, then with the one after it, and so on."""
    key, x, y, block, band, root, n = (t.column(c).to_numpy() for c in ("key", "_x", "_y", "_block", "band", "root", "n"))
    sig = _signatures(t.column("sig").combine_chunks())
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(t))[np.cumsum(new) - 1]
    i, d = np.arange(len(t)), 0
    while len(i):
        d += 1
        i = i[end[i] > i + d]
        a = i[(root[i] != root[i + d]) & ((x[i] == y[i]) | (block[i] != block[i + d]))]  # pairs within a block are another task's
        for at in range(0, len(a), 1 << 15):
            p = a[at:at + (1 << 15)]
            p = p[promising(sig, p, p + d, n, per_cent, least)]
            if len(p):
                same = (sig[p] == sig[p + d])[:, :HASHES // width * width].reshape(len(p), -1, width).all(2)
                p = p[same.argmax(1) == band[p]]
                yield p, p + d


def _rest(members: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Confirmed links between different groups (``root``) that share a bucket.

    First the members that have a promising partner at all are found from signatures; their full sets are then sent to the
    same tasks, which verify the pairs and give at most one link for each two groups that they bring together.  So rows stay as many as
    members, however many pairs a task has to look at.
    """
    least, width = least_matches(per_cent / 100), bands(per_cent / 100)[1]
    blocked = _blocks(members)

    names = "key long, _x int, _y int, _block int, band int, node long, root long, n long"
    columns = [c.split(" ")[0] for c in names.split(", ")]
    tasks = n_tasks(members.sparkSession)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "key", "_x", "_y").sortWithinPartitions("key", "_x", "_y", "node")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            hit = np.zeros(len(t), bool)
            for i, j in _block_pairs(t, least, per_cent, width):
                hit[i], hit[j] = True, True
            yield from t.select(columns).take(np.flatnonzero(hit)).to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            node, root, items = t.column("node").to_numpy(), t.column("root").to_pylist(), t.column("items").combine_chunks()
            group: dict[int, int] = {}

            def top(r: int) -> int:
                while group.get(r, r) != r:  # noqa: B023
                    r = group[r]  # noqa: B023
                return r

            a, b = [], []
            for i, j in ((i, j) for p, q in _block_pairs(t, least, per_cent, width) for i, j in zip(p.tolist(), q.tolist())):
                u, v = top(root[i]), top(root[j])
                if u != v and similar(items[i].as_py(), items[j].as_py(), per_cent):
                    group[max(u, v)] = min(u, v)
                    a.append(node[i])
                    b.append(node[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = dealt(blocked.select(*columns, "sig")).mapInArrow(find, names)
    return dealt(found.join(sets, "node").select(*columns, "sig", "items")).mapInArrow(verify, "a long, b long")


def similar(a: bytes, b: bytes, per_cent: int) -> bool:
    """Whether two full sets (sorted hashes) are similar enough."""
    s, t = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.concatenate((s, t))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= per_cent * (len(s) + len(t) - common)


def near_duplicates(docs: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their shingle sets is at least ``per_cent`` / 100; component_id is the
    smallest doc_id that links reach, and the row with that doc_id is kept.

    1. Rows with equal sets are one class.  Classes that share a band of their signatures are candidates.
    2. In every bucket each class meets the bucket's most central one (most bucket mates over all bands): as many pairs as rows,
       however large the bucket.  Signatures are compared in batches of 16 hashes and a pair is given up as soon as the posterior of
       its similarity allows; survivors are verified on the full sets, and the links give groups.
    3. Where a bucket still has several groups, classes of different groups are compared and verified with each other inside tasks of
       two blocks each.  Links within a group are not looked for: they change no component.

    A text without words, or null, has the empty set and is linked with nothing; its component is its doc_id.  Null doc_ids never
    are the smallest unless all are null.  Equal rows are in one component (and kept alike).  An empty table gives an empty result;
    other columns are left out.
    """
    signed = keep(_sign(docs, width), "signatures")
    # Equal sets have equal signatures; ids are given as the table is written, and so stay what they are.
    classes = signed.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    count, rows = bands(per_cent / 100)
    key = [F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("sig", 4 * rows * b + 1, 4 * rows)).alias("key")) for b in range(count)]
    members = classes.select("node", "n", F.explode(F.array(*key)).alias("x")).select("node", "n", "x.*")
    buckets = members.groupBy("key").agg(F.count("*").alias("count"), F.sum("n").alias("weight")).filter("count > 1")
    members = keep(members.join(buckets, "key"), "members")
    central = members.groupBy("node").agg(F.sum("count").alias("mates"))
    leaders = members.join(central, "node").groupBy("key").agg(F.max(F.struct("mates", (-F.col("node")).alias("x"))).alias("best")).select("key", (-F.col("best.x")).alias("lead"))
    stars = members.join(leaders, "key").filter("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    stars = keep(_pruned(stars, classes, per_cent), "stars")
    sets = _sets(docs, members.select("node").distinct().join(classes, "node").select("node", "first_doc", "k1", "k2", "sig"), width)
    links = keep(_confirmed(stars, sets, per_cent), "links")
    groups = keep(components(links), "groups")
    # Second look: buckets with more than one group.
    rooted = members.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    left = rooted.join(open_keys, "key").join(classes.select("node", "sig"), "node")
    more = _rest(left, sets, per_cent)
    all_links = groups.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b").unionByName(more)
    final = components(all_links)
    placed = classes.select("node", "k1", "k2", "first_doc").join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = placed.join(lowest, "root").select("k1", "k2", "component_id")
    done = signed.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return done.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, sig, items): signatures and full sets of classes, the latter from a document of each."""
    wanted = docs.select(F.col("doc_id").cast("long").alias("first_doc"), "text").join(nodes.withColumnRenamed("first_doc", "_doc"), F.col("first_doc").eqNullSafe(F.col("_doc")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            node, k1, k2, sig = (batch.column(i).to_pylist() for i in (1, 2, 3, 4))
            sets = shingle_sets(texts, width)
            own = [i for i, s in enumerate(sets) if set_name(s) == (k1[i], k2[i])]  # rows may share a doc_id
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in own], pa.int64()), pa.array([sig[i] for i in own], pa.binary()), pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["node", "sig", "items"])

    found = wanted.select("text", "node", "k1", "k2", "sig").mapInArrow(run, "node long, sig binary, items binary")
    return keep(found.groupBy("node").agg(F.first("sig").alias("sig"), F.first("items").alias("items")), "sets")


def without_near_duplicates(docs: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest doc_id.

    Rows with a null doc_id are behind all others, told apart by their texts.  Rows equal in doc_id and text are one document
    and leave one row; rows that share a doc_id and differ in text are judged as parts of one document.
    """
    own = F.when(F.col("doc_id").isNotNull(), F.col("doc_id").cast("long")).otherwise(F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2))
    rows = docs.select(F.struct("*").alias("_row"), own.alias("_id"), F.xxhash64("text").alias("_th"))
    found = keep(near_duplicates(docs.select(own.alias("doc_id"), "text"), width, per_cent), "near-duplicates")
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct()
    left = rows.join(gone, "_id", "left_anti").dropDuplicates(["_id", "_th"])
    return left.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
