"""Near-duplicate documents by HyperMinHash.

Each distinct shingle's 64-bit hash picks one of 128 buckets by its top bits; a bucket keeps the
smallest remaining value, compressed to its count of leading zeros and ten mantissa bits. Bands
of four compressed registers give candidates (registers of empty buckets are borrowed from filled
ones, so that short texts band as well), an estimate of the Jaccard index from equal registers,
corrected for chance collisions of compressed values, drops hopeless candidates, and full shingle
sets decide about the others.

Scale. Texts with equal shingle sets are one node from the start. In a bucket of candidates nodes
are first compared with two leaders, the most central nodes of different components, not with each
other; a few rounds of that join the core of each large group. After that only pairs that still lie
in different components can change the result. In small buckets they are compared; the nodes of
large ones go through an exact prefix filter: ordered by rarity, the first shingles of two linked
sets must meet, and sets far from the core have rare ones there. No group is gathered in one task:
leaders' texts are dealt out with salts, minima are pre-aggregated, and components are found by
label propagation over written tables.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.scratch import Scratch
from docloom.llm.wordhash import let_go, mix, shingle_sets

BUCKET_BITS, MANTISSA_BITS, BAND_ROWS = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // BAND_ROWS
#: Bits of the value that a register compresses.
VALUE_BITS = 53
EMPTY = 0xFFFF
#: A candidate is given up if its estimate lies so many standard errors below the threshold.
SLACK = 6.0
#: Leaders' texts are dealt out to so many tasks.
SALTS = 64
#: Buckets of more nodes get further rounds of leaders, then the prefix filter.
LARGE_BUCKET, LEADER_ROUNDS = 12, 3
#: Ratio of the size classes in which the prefix filter looks for partners.
CLASS_RATIO = 1.04
#: Bits of a shingle's hash that choose the bucket whose count tells how rare it is.
RARITY_BITS = 18

_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
_RNG = np.random.Generator(np.random.PCG64(7))
_DONORS = np.stack([_RNG.permutation(BUCKETS) for _ in range(BUCKETS)])
_BAND_SALT = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The compressed registers of a sorted set of hashes; EMPTY for buckets without one."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    if not len(shingles):
        return out
    at = np.searchsorted(shingles, _EDGES)
    filled = at < np.append(at[1:], len(shingles))
    value = (shingles[at[filled]] << np.uint64(BUCKET_BITS)) >> np.uint64(64 - VALUE_BITS)
    bits = np.maximum(value, 1).astype(np.float64).view(np.uint64)
    zeros = np.uint64(VALUE_BITS + 1022) - (bits >> np.uint64(52))
    mantissa = (bits >> np.uint64(52 - MANTISSA_BITS)) & np.uint64((1 << MANTISSA_BITS) - 1)
    out[filled] = ((zeros << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; empty registers are borrowed from the first filled bucket of
    an order drawn once for each bucket, so that equal sets borrow alike."""
    empty = regs == EMPTY
    if empty.any():
        regs = regs.copy()
        order = _DONORS[empty]
        regs[empty] = regs[order[np.arange(len(order)), np.argmin(empty[order], axis=1)]]
    return mix(np.ascontiguousarray(regs).view(np.uint64) + _BAND_SALT).view(np.int64)


@lru_cache(maxsize=4096)
def _chance(n: int, m: int) -> float:
    """Probability that a register of two disjoint sets of n and m hashes is filled and equal."""
    zeros = np.arange(VALUE_BITS)[:, None]
    step = np.arange((1 << MANTISSA_BITS) + 1)[None, :] / (1 << MANTISSA_BITS)
    edge = (1 + step) * 2.0 ** -(zeros + 1) / BUCKETS
    above_n, above_m = (np.exp(k * np.log1p(-edge)) for k in (n, m))
    return float(((above_n[:, :-1] - above_n[:, 1:]) * (above_m[:, :-1] - above_m[:, 1:])).sum())


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> tuple[float, int]:
    """The collision-corrected Jaccard index and the number of registers it rests on."""
    used = int(((a != EMPTY) | (b != EMPTY)).sum())
    same = int(((a == b) & (a != EMPTY)).sum())
    near = lambda k: int(2 ** (round(4 * np.log2(k)) / 4))
    by_chance = BUCKETS * _chance(near(max(n, 1)), near(max(m, 1)))
    if used <= by_chance:
        return 0.0, used
    return max(0.0, (same - by_chance) / (used - by_chance)), used


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            size, mark, regs, keys = [], [], [], []
            for found in shingle_sets(batch.column(1), width):
                size.append(len(found))
                mark.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                r = registers(found)
                regs.append(r.tobytes())
                keys.append(band_keys(r) if len(found) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(mark, pa.binary()), pa.array(regs, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "n_shingles", "mark", "regs", "bands"],
            )

    return run


def _promising(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[2:]]
            keep = []
            for n, m, a, b in zip(*cols, strict=True):
                j, used = estimate(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16), n, m)
                keep.append(j + SLACK * (threshold * (1 - threshold) / max(used, 1)) ** 0.5 >= threshold)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(width: int, percent: int):
    """Rows sorted by (a, salt, b), a leader's own row (b null) first: the pairs whose sets match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaders = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for (a, salt, b), found in zip(ids, shingle_sets(batch.column(3), width), strict=True):
                if key != (a, salt):
                    key, leaders = (a, salt), []
                if b is None:
                    leaders.append(found)
                    continue
                for own in leaders:
                    both = len(np.intersect1d(own, found, assume_unique=True))
                    if both and 100 * both >= percent * (len(own) + len(found) - both):
                        out.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp): the smallest node reachable over (a, b), by neighbours' minima and pointer jumping.

    Every pass is a join and a pre-aggregated minimum over written tables; nothing is collected
    but the number of changes.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    label = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "label0")
    turn = 0
    while True:
        around = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = label.join(around, "node").select("node", F.least("comp", "m").alias("comp"), F.col("comp").alias("was"))
        jump = step.alias("s").join(label.select(F.col("node").alias("comp"), F.col("comp").alias("far")), "comp", "left")
        turn += 1
        moved = scratch.keep(jump.select("node", F.least("comp", "far").alias("comp"), "was"), f"label{turn}")
        changed = moved.where("comp <> was").limit(1).count()
        scratch.drop(f"label{turn - 1}")
        label = moved.drop("was")
        if not changed:
            return label


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of distinct
    width-word shingles (words end at ASCII white space, A-Z count as a-z; a text of fewer words
    is one shingle). component_id is the smallest id reachable by links, kept says whether that is
    the row's own. Null and empty texts and texts without words have n_shingles 0 and no link.
    Equal rows stay as rows; rows that share an id count as one document for links. A row with a
    null id has no component (null) and is kept. Other columns, whatever their names, play no
    part. An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketches = scratch.keep(base.mapInArrow(_sketch(width), "doc_id long, n_shingles long, mark binary, regs binary, bands array<long>"), "sketches")

    first = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("mark").agg(F.min(F.struct("doc_id", "n_shingles", "regs", "bands")).alias("x"))
    nodes = scratch.keep(first.select("mark", F.col("x.doc_id").alias("node"), F.col("x.n_shingles").alias("n"), "x.regs", "x.bands"), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("bucket", "size")
    buckets = scratch.keep(banded.join(shared, "bucket"), "buckets")
    central = scratch.keep(buckets.groupBy("node").agg(F.sum("size").alias("score")), "central")
    texts = scratch.keep(base.where("text IS NOT NULL").join(central.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), "texts")

    linked = _Links(scratch, nodes.select("node", "n", "regs"), texts, width, percent)
    buckets = buckets.join(central, "node")
    mixed = linked.mixed(buckets)
    for turn in range(LEADER_ROUNDS):
        rows = mixed if not turn else mixed.where(F.col("size") > LARGE_BUCKET)
        if turn and not rows.limit(1).count():
            break
        linked.test(_pairs(rows, "leader").union(_pairs(rows, "other")))
        mixed = linked.mixed(buckets)
    a, b = (mixed.where(F.col("size") <= LARGE_BUCKET).select("bucket", F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
    near = a.join(b, "bucket").where("a < b AND comp_a <> comp_b").select("a", "b")
    rest = mixed.where(F.col("size") > LARGE_BUCKET).select("node", "comp").distinct()
    if rest.limit(1).count():
        near = near.union(_prefix_pairs(scratch, rest, texts, width, percent))
    linked.test(near)

    label = linked.label()
    of_mark = nodes.select("mark", "node").join(label, "node", "left").select("mark", F.coalesce("comp", "node").alias("comp"))
    out = sketches.select("doc_id", "n_shingles", "mark").join(of_mark, "mark", "left")
    own = F.when(F.col("n_shingles") > 0, F.least("comp", "doc_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id is that of their component, with all columns, whatever their names; rows
    of null ids stay. Null and empty texts are alike to nothing and stay; an empty table stays empty."""
    kept = near_duplicates(docs, doc_id, text, width, percent).where("kept").select(F.col("doc_id").alias("kept")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{doc_id}`").cast("long").alias("id"))
    return rows.join(kept, F.col("id").eqNullSafe(F.col("kept")), "left_semi").select("row.*")


def _pairs(mixed: DataFrame, leader: str) -> DataFrame:
    """Each node with the leader of its bucket, unless they are in one component."""
    at = F.col(leader).getField("node")
    return mixed.where(F.col("comp") != F.col(leader).getField("comp")).select(F.least("node", at).alias("a"), F.greatest("node", at).alias("b"))


def _bucket_counts(width: int):
    """How many shingles of the nodes of a task fall into each bucket of hashes; empty ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for found in shingle_sets(batch.column(1), width):
                np.add.at(counts, found >> np.uint64(64 - RARITY_BITS), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "c"])

    return run


def _prefix_rows(width: int, percent: int, counts):
    """node, n, shingle and at (its place in the order) of the first shingles of each node, rare buckets first. A
    shingle alone in its bucket meets nothing and has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counts.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for node, found in zip(ids, shingle_sets(batch.column(1), width), strict=True):
                often, n = held[found >> np.uint64(64 - RARITY_BITS)], len(found)
                first = np.lexsort((found, often))[: n - math.ceil(percent / 100 * n - 1e-6) + 1]
                at = np.flatnonzero(often[first] > 1)
                columns = [np.full(len(at), node), np.full(len(at), n, np.int64), found[first[at]].view(np.int64), at.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "n", "shingle", "at"])

    return run


def _prefix_pairs(scratch: Scratch, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """All pairs of nodes in different components whose sets can be linked, by an exact prefix filter.

    Sets of n and m elements are linked only if they share at least o = percent * (n + m) / (100 +
    percent) elements, and then, in one order of all elements, the first n - o + 1 of one and the
    first m - o + 1 of the other meet. Elements of rare buckets of hashes come first, so that a table of fixed
    size orders them where a text lies and only a node's first ones leave it. A node looks for partners by
    classes of size, so that no more of its elements count than the class allows, and the elements'
    prevalent component only answers: two of its nodes need no comparison.
    """
    part = percent / (100 + percent)
    overlap = lambda n, m: F.ceil(F.lit(part) * (n + m) - F.lit(1e-6))
    held = scratch.keep(texts.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), "held")
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    for bucket, c in held.mapInArrow(_bucket_counts(width), "bucket int, c long").groupBy("bucket").agg(F.sum("c")).collect():  # of a fixed size
        counts[bucket] = c
    counts = scratch.spark.sparkContext.broadcast(counts)
    rows = held.mapInArrow(_prefix_rows(width, percent, counts), "node long, n long, shingle long, at long")
    size_class = lambda n: F.floor(F.log(n) / F.log(F.lit(CLASS_RATIO))).cast("int")
    first = scratch.keep(rows.join(nodes, "node").select("shingle", "node", "comp", "n", "at", size_class(F.col("n")).alias("class")), "prefixes")
    by_comp = first.groupBy("shingle", "comp").agg(F.count("*").alias("c"))
    main = by_comp.groupBy("shingle").agg(F.max_by("comp", "c").alias("main"), F.count("*").alias("comps")).where("comps > 1").select("shingle", "main")
    low, high = low_of(percent, "n"), F.floor(F.col("n") * 100 / percent + F.lit(1e-6))
    asking = first.join(main, "shingle").where("comp <> main").withColumn("class", F.explode(F.sequence(size_class(low) - 1, size_class(high) + 1)))
    least = F.greatest(low, F.floor(F.pow(F.lit(CLASS_RATIO), F.col("class"))) - 1)
    asking = asking.where(F.col("at") <= F.col("n") - overlap(F.col("n"), least)).select("shingle", "class", F.col("node").alias("x"), F.col("comp").alias("comp_x"), F.col("n").alias("n_x"), F.col("at").alias("at_x"))
    most = overlap(F.col("n"), F.col("n_x"))
    ok = (F.col("comp") != F.col("comp_x")) & (F.col("n").between(low_of(percent, "n_x"), F.floor(F.col("n_x") * 100 / percent + F.lit(1e-6)))) & (F.col("at_x") <= F.col("n_x") - most) & (F.col("at") <= F.col("n") - most)
    return asking.join(first, ["shingle", "class"]).where(ok).select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))


def low_of(percent: int, size: str) -> Column:
    """The smallest set that can be linked with one of that size."""
    return F.ceil(F.lit(percent / 100) * F.col(size) - F.lit(1e-6))


class _Links:
    """Confirmed links, the pairs already looked at, and the components so far."""

    def __init__(self, scratch: Scratch, side: DataFrame, texts: DataFrame, width: int, percent: int):
        self.scratch, self.side, self.texts, self.width, self.percent = scratch, side, texts, width, percent
        self.tested: DataFrame | None = None
        self.edges: DataFrame | None = None
        self.known: DataFrame | None = None
        self.turn = 0

    def test(self, pairs: DataFrame) -> None:
        keep, side, self.turn = self.scratch.keep, self.side, self.turn + 1
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        sized = pairs.join(side.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("regs_a")), "a")
        sized = sized.join(side.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b")), "b")
        sized = sized.where(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        hopeful = sized.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(_promising(self.percent / 100), "a long, b long")
        hopeful = keep(hopeful.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")), f"hopeful{self.turn}")
        own = hopeful.select("a", "salt").distinct().join(self.texts.withColumnRenamed("doc_id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
        rest = hopeful.join(self.texts.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "text")
        dealt = own.union(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        found = keep(dealt.mapInArrow(_confirmed(self.width, self.percent), "a long, b long"), f"found{self.turn}")
        tested = hopeful.select("a", "b")
        self.tested = tested if self.tested is None else self.tested.union(tested)
        self.edges = found if self.edges is None else self.edges.union(found)
        self.known = None

    def label(self) -> DataFrame:
        if self.known is None:
            self.known = components(self.edges, Scratch(self.scratch.spark, "components"))
        return self.known

    def mixed(self, buckets: DataFrame) -> DataFrame:
        """Rows of the buckets that hold more than one component, with the most central node of all
        and the most central one of another component."""
        rows = buckets
        if self.edges is not None:
            rows = rows.join(self.label(), "node", "left")
        rows = rows.select("bucket", "size", "node", "score", F.coalesce("comp", "node").alias("comp") if self.edges is not None else F.col("node").alias("comp"))
        best = lambda name: F.max(F.struct("score", "node", "comp")).alias(name)
        led = rows.join(rows.groupBy("bucket").agg(best("leader")), "bucket")
        other = led.where(F.col("comp") != F.col("leader.comp")).groupBy("bucket").agg(best("other"))
        return self.scratch.keep(led.join(other, "bucket"), f"mixed{self.turn}")
