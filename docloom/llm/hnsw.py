"""Approximate nearest neighbours by hierarchical navigable small worlds.

Distinct vectors are dealt into shards of a bounded size by their hash. Each shard is a graph of
layers, kept as flat arrays: for each layer one array of neighbour numbers with a fixed number of
slots for each node (-1: free). Every query goes to every shard, in blocks, and the shards'
results are merged. Nearness is the Euclidean distance in double precision.

Scale. Equal vectors are one node, which stands for at most k + 1 of their smallest ids (kept by a
limit before the exchange), so that a vector that a third of the rows share costs nothing more.
A shard's index is a row of a written table that moves once; blocks of queries travel to it. A task
holds one shard at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.scratch import Scratch

#: Vectors of a shard; beyond MANY_SHARDS shards they grow with the table, to MOST_ROWS at most.
SHARD_ROWS, MANY_SHARDS, MOST_ROWS = 4096, 256, 1 << 18
#: Queries that travel together; with fewer shards than LEAST_TASKS an index is searched in copies.
BLOCK_QUERIES, LEAST_TASKS = 256, 8
M, EF_BUILD, EF_SEARCH = 16, 96, 128


class Graph:
    """The layers of one shard; vectors: float64, a row each."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None, entry: int = 0):
        self.vectors, self.layers, self.entry = vectors, layers or [], entry

    @classmethod
    def build(cls, vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 0) -> Graph:
        n = len(vectors)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(m)).astype(int), 6)
        graph = cls(vectors, [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(level.max() + 1)])
        top = int(level[0])
        for i in range(1, n):
            near, at = [(graph._far(i, graph.entry), graph.entry)], graph.entry
            for k in range(top, -1, -1):
                near = graph._layer(vectors[i], [x for _, x in near], ef if k <= level[i] else 1, k)
                if k <= level[i]:
                    graph._link(i, k, graph._spread(near, m))
            if level[i] > top:
                top, graph.entry = int(level[i]), i
        return graph

    def _far(self, i: int, j: int) -> float:
        gap = self.vectors[i] - self.vectors[j]
        return float(gap @ gap)

    def _spread(self, near: list[tuple[float, int]], m: int) -> list[int]:
        """The neighbour choice: near ones that are nearer to the node than to those chosen; then the nearest left."""
        chosen: list[int] = []
        rest: list[int] = []
        for far, x in near:
            if len(chosen) == m:
                break
            gap = self.vectors[chosen] - self.vectors[x]
            (chosen if not chosen or float((gap * gap).sum(1).min()) > far else rest).append(x)
        return chosen + rest[: m - len(chosen)]

    def _link(self, i: int, k: int, others: list[int]) -> None:
        slots = self.layers[k]
        slots[i, : len(others)] = others
        for x in others:
            free = np.flatnonzero(slots[x] < 0)
            if len(free):
                slots[x, free[0]] = i
                continue
            around = np.append(slots[x], i)
            gap = self.vectors[around] - self.vectors[x]
            far = (gap * gap).sum(1)
            order = np.argsort(far, kind="stable")
            chosen = self._spread([(float(far[j]), int(around[j])) for j in order], len(slots[x]))
            slots[x] = -1
            slots[x, : len(chosen)] = chosen

    def _layer(self, q: np.ndarray, entries: list[int], ef: int, k: int) -> list[tuple[float, int]]:
        """The ef nearest found from the entries on one layer, nearest first."""
        slots, vectors = self.layers[k], self.vectors
        seen = np.zeros(len(vectors), bool)
        entries = list(dict.fromkeys(entries))
        seen[entries] = True
        gap = vectors[entries] - q
        todo = list(zip((gap * gap).sum(1).tolist(), entries, strict=True))
        best = [(-d, x) for d, x in todo]
        heapq.heapify(todo)
        heapq.heapify(best)
        while len(best) > ef:
            heapq.heappop(best)
        while todo:
            d, x = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= ef:
                break
            around = slots[x]
            around = around[around >= 0]
            around = around[~seen[around]]
            if not len(around):
                continue
            seen[around] = True
            gap = vectors[around] - q
            for e, y in zip(np.einsum("ij,ij->i", gap, gap).tolist(), around.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-e, y))
                    heapq.heappush(todo, (e, y))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, y))
                    heapq.heappush(todo, (e, y))
        return sorted((-d, x) for d, x in best)

    def search(self, q: np.ndarray, ef: int = EF_SEARCH) -> list[tuple[float, int]]:
        near = [(0.0, self.entry)]
        for k in range(len(self.layers) - 1, 0, -1):
            near = self._layer(q, [x for _, x in near], 1, k)
        return self._layer(q, [x for _, x in near], ef, 0)


def _built(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one or more shards, sorted by shard, to a row for each shard's index."""
    key, rows = None, []

    def done():
        vectors = np.array([v for _, v in rows], np.float64)
        graph = Graph.build(vectors)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([[i for i, _ in rows]], pa.list_(pa.list_(pa.int64()))), pa.array([vectors.astype(np.float32).tobytes()], pa.binary()),
             pa.array([[x.tobytes() for x in graph.layers]], pa.list_(pa.binary())), pa.array([[x.shape[1] for x in graph.layers]], pa.list_(pa.int32())), pa.array([graph.entry], pa.int32())],
            names=["dim", "shard", "ids", "vectors", "layers", "slots", "entry"],
        )

    for batch in groups:
        for dim, shard, ids, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (dim, shard) != key:
                if rows:
                    yield done()
                key, rows = (dim, shard), []
            rows.append((ids, vector))
    if rows:
        yield done()


_INDEX = "dim int, shard int, ids array<array<long>>, vectors binary, layers array<binary>, slots array<int>, entry int"


def _searched(k: int, ef: int):
    """Rows sorted by dim, shard and copy, a shard's index (queries null) before its blocks of queries, to
    each query's k nearest in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, ids = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                if not row["queries"].is_valid:
                    vectors = np.frombuffer(row["vectors"].as_py(), np.float32).reshape(-1, row["dim"].as_py()).astype(np.float64)
                    layers = [np.frombuffer(x, np.int32).reshape(len(vectors), -1) for x in row["layers"].as_py()]
                    graph, ids = Graph(vectors, layers, row["entry"].as_py()), row["ids"].as_py()
                    continue
                out = []
                for q in row["queries"].as_py():
                    own, vector = q["query_id"], np.array(q["embedding"], np.float64)
                    found: list[tuple[float, int]] = []
                    for _, x in graph.search(vector, max(ef, k + 1)):
                        gap = graph.vectors[x] - vector
                        score = float(np.sqrt((gap * gap).sum()))
                        found += [(score, v) for v in ids[x] if v != own]
                    out += [(own, v, s) for s, v in sorted(found)[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and embedding (array<float>) of rows with an id and a vector that is not null or zero
    and has no null and no non-finite component."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>").alias("embedding")).where(F.col("vec_id").isNotNull() & fine)


def shard_count(n: int, shard_rows: int = SHARD_ROWS) -> int:
    """Shards of shard_rows vectors; beyond MANY_SHARDS of them shards grow, to MOST_ROWS vectors at most,
    as every query asks every shard."""
    return max(1, -(-n // min(max(shard_rows, n // MANY_SHARDS), max(shard_rows, MOST_ROWS))))


def build_index(rows: DataFrame, scratch: Scratch, keep_ids: int, shards: int) -> DataFrame:
    """A row for each shard's graph. Every usable row is indexed; equal vectors are one node with their keep_ids smallest ids."""
    # repeated rows go before ranks are given: they take no place of other ids, and no task sees all of them
    small = rows.select("vec_id", "embedding").distinct().withColumn("rank_", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("rank_") <= keep_ids)
    nodes = small.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    dealt = nodes.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"), "ids", "embedding")
    # a range for each shard, so that no task builds two graphs while another has none
    dealt = dealt.repartitionByRange(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "embedding")
    return scratch.keep(dealt.mapInArrow(_built, _INDEX), "index")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, ef: int = EF_SEARCH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found for each query.

    rows and queries: vec_id and embedding. A query's own id is no candidate; ties go to the
    smaller id. Only vectors of a query's own length are candidates. Unusable vectors (see usable)
    take no part; repeated rows with one id count once. With fewer candidates all are returned; an
    empty table gives an empty result.
    """
    scratch = Scratch(rows.sparkSession, "hnsw")
    base = scratch.keep(usable(rows), "vectors")
    shards = shard_count(base.count(), shard_rows)
    index = build_index(base, scratch, k + 1, shards)
    asked = usable(queries).select(F.col("vec_id").alias("query_id"), "embedding").dropDuplicates(["query_id"])
    n_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    blocks = asked.withColumn("dim", F.size("embedding")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    blocks = blocks.groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "embedding")).alias("queries"))
    # blocks travel to the shards of their dimension; an index moves once, or with few shards in a few copies
    copies = max(1, min(n_blocks, LEAST_TASKS // shards))
    held = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "ids", "vectors", "layers", "entry", F.lit(None).cast("array<struct<query_id:bigint,embedding:array<float>>>").alias("queries"))
    # a block for each shard that its dimension has: the keys are as many as shards, not as dimensions
    each = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(index.select("dim", "shard"), ["dim", "shard"])
    sent = each.select("dim", "shard", F.pmod("block", F.lit(copies)).cast("int").alias("copy"), *(F.lit(None).cast(t).alias(c) for c, t in index.dtypes if c in ("ids", "vectors", "layers", "entry")), "queries")
    key = ["dim", "shard", "copy"]
    tasks = held.union(sent).repartition(shards * copies, *key).sortWithinPartitions(*key, F.col("queries").isNotNull())
    found = tasks.mapInArrow(_searched(k, ef), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
