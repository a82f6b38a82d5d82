"""Sparse, dense and fused retrieval for batches of queries."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import tokens
from docloom.scratch import Scratch

K1, B, EPSILON = 1.5, 0.75, 0.25
DENSE_WEIGHT, SPARSE_WEIGHT = 0.6, 0.4
#: About so many queries meet a block of about so many vectors; queries scored at a time.
BLOCK_QUERIES, BLOCK_VECTORS, PIECE = 1 << 16, 8192, 256
#: Bytes of the texts of a bucket of the inverted index, and the most buckets; documents of a block of it.
BUCKET_BYTES, MOST_BUCKETS, BLOCK_DOCS = 4_000_000, 50_000, 1024
#: Words of queries that a task holds at once; a search of more takes the queries in several passes.
PASS_WORDS = 500_000
#: Tasks of a pass for each core: each gives the k best of every query.
TASKS_A_CORE = 3
#: Postings, or pairs of a query and a document, that a task scores at once.
CELLS = 1 << 20
#: One block in so many is scored whole to learn which scores cannot be among the best; not fewer than so many.
PROBE_PART, LEAST_PROBED = 32, 4
#: A search that matches fewer postings reads them all; so does a query of which the bounds leave more than
#: PRUNED_PART of its postings to be read. Pruning moves postings and bounds between tasks, while a task that
#: reads its postings where they lie moves the k best of a block alone, so that no search prunes unless told to.
PRUNE_FROM, PRUNED_PART = math.inf, 0.2
#: Scores are rounded to 6 places and sums have no fixed order.
SLACK = 2e-6


@dataclass(frozen=True)
class Index:
    """A written inverted index. postings (block, doc_id, term, tf, impact) are dealt by blocks of documents,
    so that a task scores whole documents and keeps its k best before any exchange; impact is what the
    term adds to a score for each unit of weight. bounds: block, term, most (the block's greatest
    impact); terms: term, df, idf, most."""

    documents: DataFrame
    postings: DataFrame
    bounds: DataFrame
    terms: DataFrame
    blocks: int
    n: int


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that end in t (tokens) to a row for each distinct token, with length, term and tf in its place."""
    for batch in batches:
        own = pa.Table.from_batches([batch])
        lists = own["t"].combine_chunks()
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int32)
        found = lists.flatten().dictionary_encode()
        many = max(len(found.dictionary), 1)
        of, tf = np.unique(np.repeat(np.arange(len(length)), length) * many + found.indices.to_numpy(), return_counts=True)
        row = pa.array(of // many)
        out = own.drop_columns(["t"]).take(row)
        columns = [*(c.combine_chunks() for c in out.columns), pa.array(length).take(row), found.dictionary.take(pa.array(of % many)), pa.array(tf.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=[*out.column_names, "length", "term", "tf"])


def term_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """more columns, doc_id, length, term and tf of each document, counted where it lies, a batch of documents
    at a time. A null text has no tokens; the document counts all the same."""
    rows = docs.select(*more, F.col(doc_id).alias("doc_id"), tokens(text).alias("t"))
    kept = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(_counted, f"{kept}, length int, term string, tf long")


def term_weights(posting: DataFrame, n: int) -> DataFrame:
    """term, df, idf, most: terms in more than half of the n documents get a part of the mean weight."""
    raw = posting.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("most")).withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf"), "most")  # one row


def _block(doc_id: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(blocks)).alias("block")


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of all docs, written once in the shared folder. Ids are distinct."""
    scratch = Scratch(docs.sparkSession, "bm25")
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col(text)))).first()
    buckets, blocks = min(MOST_BUCKETS, max(8, (size or 0) // BUCKET_BYTES)), max(8, -(-n // BLOCK_DOCS))
    dealt = docs.select(_block(F.col(doc_id), blocks), doc_id, text).repartition(buckets, "block")
    counts = scratch.keep_bucketed(term_counts(dealt, doc_id, text, "block"), "counts", buckets, "block", [])
    scratch.free()
    mean = max((counts.agg(F.sum("tf")).first()[0] or 0) / max(n, 1), 1e-9)
    impact = (K1 + 1) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    postings = counts.select("block", "doc_id", "term", "tf", impact.alias("impact"))
    bounds = postings.groupBy("block", "term").agg(F.max("impact").alias("most"))
    return Index(docs.select(F.col(doc_id).alias("doc_id")), postings, bounds, scratch.keep(term_weights(postings, n), "terms"), blocks, n)


def _weights(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, term, weight, most and df of the query words that the index has."""
    asked = queries.select("query_id", F.explode(tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    return asked.join(index.terms, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"), "most", "df")


def _bound(most: str = "most") -> Column:
    """The most that a term adds to a score; a negative weight adds nothing at most."""
    return F.greatest(F.col("weight") * F.col(most), F.lit(0.0))


def _essential(rows: DataFrame, *of: str) -> DataFrame:
    """rows (weight, most, floor) with essential: of the terms of least bounds, those that stay under the
    floor together are not; a document that has no other term than them cannot reach it."""
    w = Window.partitionBy(*of).orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("bound", _bound())
    return rows.withColumn("essential", F.sum("bound").over(w) >= F.col("floor") - SLACK)


def _scores(postings: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
    rows = postings.join(asked, on)
    return rows.groupBy("block", "query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("part"))


def _best_of_block(k: int, cut: bool):
    """The postings of a block of documents and the words of queries (no, weight) to each query's k best
    documents of the block; if cut, of those whose ids stand among the words' rows."""

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        if cut:
            held = held.filter(pc.is_in(held["doc_id"], value_set=asked["doc_id"].combine_chunks().drop_null()))
        words = asked.filter(pc.is_valid(asked["no"]))
        docs, queries = (t[c].combine_chunks().dictionary_encode() for t, c in ((held, "doc_id"), (words, "query_id")))
        # documents are numbered by their ids, so that ties fall to the smaller one
        order = pc.sort_indices(docs.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        no = held["no"].to_numpy()
        by = np.argsort(no, kind="stable")
        no, doc, impact = no[by], place[docs.indices.to_numpy()][by], held["impact"].to_numpy()[by]
        of, word, weight = queries.indices.to_numpy(), words["no"].to_numpy(), words["weight"].to_numpy()
        by = np.lexsort((word, of))
        of, word, weight = of[by], word[by], weight[by]
        low, high = (np.searchsorted(no, word, side) for side in ("left", "right"))
        met = high > low
        of, weight, low, size = of[met], weight[met], low[met], (high - low)[met]
        wide = len(order)
        # queries are taken many at a time, so that a batch has about CELLS postings or pairs of a query and a document
        every, first = np.unique(of, return_index=True)
        ends = np.append(first, len(of))
        batch = np.cumsum(np.maximum(np.add.reduceat(size, first), wide)) // CELLS if len(of) else first
        own, found, parts = [], [], []
        for some in np.split(np.arange(len(every)), np.flatnonzero(np.diff(batch)) + 1) if len(of) else ():
            a, b = ends[some[0]], ends[some[-1] + 1]
            each, total = size[a:b], int(size[a:b].sum())
            at = np.repeat(low[a:b] - (np.cumsum(each) - each), each) + np.arange(total)
            cell = np.repeat((np.searchsorted(every, of[a:b]) - some[0]) * wide, each) + doc[at]
            score = np.bincount(cell, np.repeat(weight[a:b], each) * impact[at], len(some) * wide)
            seen = np.zeros(len(score), bool)
            seen[cell] = True
            score = score.reshape(-1, wide)
            value = np.where(seen.reshape(-1, wide), np.round(score, 6), -np.inf)
            best = value > -np.inf
            if wide > k:
                best &= value >= np.partition(value, wide - k, axis=1)[:, wide - k, None]
            q, d = np.nonzero(best)
            by = np.lexsort((-value[q, d], q))  # stable: ties keep the order of documents
            q, d = q[by], d[by]
            top = np.arange(len(q)) - np.searchsorted(q, q) < k
            own.append(every[some[0] + q[top]])
            found.append(d[top])
            parts.append(score[q[top], d[top]])
        own, found, parts = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((own, np.int64), (found, np.int64), (parts, np.float64)))
        return pa.table({"query_id": queries.dictionary.take(pa.array(own)), "doc_id": docs.dictionary.take(pa.array(order[found])), "part": parts})

    return run


def _where_it_lies(told, k: int):
    """The postings of a block (doc_id, term, impact) to each query's k best; and the same of the documents in a
    second table. told holds the distinct terms of a pass and its words (query_id, no, weight)."""

    def every(held: pa.Table) -> pa.Table:
        terms, asked = told.value
        no = pc.index_in(held["term"], value_set=terms)
        held = pa.table({"doc_id": held["doc_id"], "no": no.cast(pa.int64()), "impact": held["impact"]})
        return _best_of_block(k, False)(held.filter(pc.is_valid(no)), asked)

    def some(held: pa.Table, allowed: pa.Table) -> pa.Table:
        return every(held.filter(pc.is_in(held["doc_id"], value_set=allowed["doc_id"].combine_chunks())))

    return every, some


def _told(words: DataFrame):
    """The words of a pass (query_id, term, weight), at most about PASS_WORDS of them, sent to each executor once."""
    own = words.select("query_id", "term", "weight").toArrow()
    found = own["term"].combine_chunks().dictionary_encode()
    asked = pa.table({"query_id": own["query_id"], "no": found.indices.cast(pa.int64()), "weight": own["weight"]})
    return words.sparkSession.sparkContext.broadcast((found.dictionary, asked))


def _best(index: Index, asked: DataFrame, rows: int, k: int, allowed: DataFrame | None, scratch: Scratch) -> DataFrame:
    """query_id, doc_id, part of each query's k best, for asked (rows of them). Neither postings nor words are
    dealt: each executor gets the words of a pass once, and a task's hits of all its blocks are cut to the k best
    before they leave it, so that what moves grows with the queries and the tasks at once, not with the blocks. A pass is
    written and its shuffle files are freed before the next one."""
    types = {c: t for frame in (index.postings, asked) for c, t in frame.dtypes}
    out = f"query_id {types['query_id']}, doc_id {types['doc_id']}, part double"
    held = index.postings.select("block", "doc_id", "term", "impact").groupBy("block")
    tasks = TASKS_A_CORE * asked.sparkSession.sparkContext.defaultParallelism
    found, passes = [], max(1, -(-rows // PASS_WORDS))
    for i in range(passes):
        told = _told(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i) if passes > 1 else asked)
        every, some = _where_it_lies(told, k)
        if allowed is None:
            scored = held.applyInArrow(every, out)
        else:
            own = F.col("doc_id").cast(types["doc_id"])
            cut = allowed.select(_block(own, index.blocks), own.alias("doc_id"))
            scored = held.cogroup(cut.groupBy("block")).applyInArrow(some, out)
        best = _top(scored.coalesce(tasks).withColumn("score", F.round("part", 6)), k)
        found.append(scratch.keep(best.select("query_id", "doc_id", "part"), f"pass{i}"))
        told.destroy()
        if passes > 1:
            scratch.free()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _top(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class _Plan:
    """The steps of a search, each a table: whole (query_id, term, weight: words of queries that read all
    postings), first (query_id, block, term, weight: postings that are read for all documents of a
    block), rest (those that are read for candidates alone) and candidates (block, query_id, doc_id, part)."""

    whole: DataFrame
    first: DataFrame
    rest: DataFrame
    candidates: DataFrame
    probed: DataFrame


def _plan(index: Index, postings: DataFrame, asked: DataFrame, k: int, scratch: Scratch) -> _Plan:
    # the k-th score in a part of the documents is a floor for that in all
    probed = postings.where(F.col("block") < max(LEAST_PROBED, index.blocks // PROBE_PART))
    found = _top(_scores(probed, asked, ["term"]).select("query_id", "doc_id", F.col("part").alias("score")), k)
    floors = found.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k).select("query_id", "floor")
    rows = _essential(asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "query_id")
    own = Window.partitionBy("query_id")
    read = F.sum(F.when(F.col("essential"), F.col("df")).otherwise(0)).over(own) / F.sum("df").over(own)
    rows = scratch.keep(rows.withColumn("pruned", read <= PRUNED_PART).drop("bound", "most"), "floored")
    asked = rows.where("pruned")
    # blocks that have a term which is essential for the whole corpus; then the terms that are for the block
    blocks = index.bounds.join(asked.where("essential").select("query_id", "term"), "term").select("query_id", "block").distinct()
    spread = blocks.join(asked.select("query_id", "term", "weight", "floor"), "query_id").join(index.bounds, ["block", "term"])
    spread = scratch.keep(_essential(spread, "block", "query_id").select("query_id", "block", "term", "weight", "bound", "floor", "essential"), "spread")
    first, rest = spread.where("essential"), spread.where("NOT essential")
    more = spread.groupBy("block", "query_id").agg(F.sum(F.when(F.col("essential"), 0.0).otherwise(F.col("bound"))).alias("more"), F.first("floor").alias("floor"))
    parts = _scores(postings, first.select("query_id", "block", "term", "weight"), ["block", "term"])
    parts = parts.join(more, ["block", "query_id"]).where(F.col("part") + F.col("more") >= F.col("floor") - SLACK)
    candidates = scratch.keep(parts.select("block", "query_id", "doc_id", "part"), "candidates")
    return _Plan(rows.where("NOT pruned").select("query_id", "term", "weight"), first, rest, candidates, probed)


def _pruned(index: Index, postings: DataFrame, asked: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    plan = _plan(index, postings, asked, k, scratch)
    asked = plan.candidates.join(plan.rest.select("block", "query_id", "term", "weight"), ["block", "query_id"])
    rest = index.postings.join(asked, ["block", "doc_id", "term"]).select("block", "query_id", "doc_id", (F.col("weight") * F.col("impact")).alias("part"))
    some = plan.candidates.unionByName(rest).groupBy("block", "query_id", "doc_id").agg(F.sum("part").alias("part"))
    return some.unionByName(_scores(postings, plan.whole, ["term"]))


def bm25(docs: DataFrame | Index, queries: DataFrame, k: int = 10, where: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each query.

    docs: a table of documents, or its index, which many calls can share. queries: query_id and
    query. Corpus statistics cover all docs; where (a table with doc_id) cuts hits before the k best
    are taken. A repeated query word counts as often as it stands there. Scores are rounded to 6
    places, ties go to the smaller id, and documents without any query word fill up to k with score 0.
    An empty query has no words: its hits are the first k documents.

    The words of all queries go to each executor, the postings of blocks of documents are read where they lie, and
    the k best of each task are merged. A search from PRUNE_FROM on does not read all postings: a part of the
    blocks gives each query a floor that its k-th score reaches; elsewhere a document counts only if
    it has a term without which it stays under the floor, by the bounds of its block, and its other
    postings are read only if the sum of what it has and the bounds of the rest reaches the floor.
    Queries of many common words, for which the bounds rule out little, read all of theirs.
    """
    index = docs if isinstance(docs, Index) else build_index(docs, doc_id, text)
    scratch = Scratch(queries.sparkSession, "bm25-search")
    allowed = index.documents if where is None else where.select(F.col(doc_id).alias("doc_id")).distinct()
    asked = scratch.keep(_weights(index, queries), "asked")
    matched, rows = asked.agg(F.sum("df"), F.count("*")).first()
    if (matched or 0) < PRUNE_FROM:
        scores = _best(index, asked, rows, k, None if where is None else allowed, scratch)
    else:
        postings = index.postings if where is None else index.postings.join(allowed, "doc_id", "left_semi")
        scores = _pruned(index, postings, asked, k, scratch)
    # both readers below take the written hits
    best = scratch.keep(_top(scores.select("query_id", "doc_id", F.round("part", 6).alias("score")), k), "best")
    # with fewer than k hits, the first 2k documents hold all that can fill up
    short = queries.select("query_id").join(best.where(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
    first = allowed.orderBy("doc_id").limit(2 * k)
    spare = short.crossJoin(F.broadcast(first)).join(best.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return scratch.keep(_top(best.drop("rank").unionByName(spare), k).select("query_id", "doc_id", "score", "rank"), "hits")


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def usable(rows: DataFrame, own: str, vector: str, *numbers: str) -> DataFrame:
    """Rows with an id and a vector of finite numbers, in double precision; other columns go."""
    rows = rows.select(F.col(own).cast("long").alias(own), F.col(vector).cast("array<double>").alias(vector), *(F.col(c).cast("double").alias(c) for c in numbers))
    good = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(own).isNotNull() & F.col(vector).isNotNull() & good)


def best_of_group(k: int, same: str | None):
    """A block of vectors and the queries that read it to the k best of each query in the block. Queries are
    scored PIECE at a time, so that a task holds the two tables and few scores."""

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        v = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        size = np.sqrt((v * v).sum(1, keepdims=True))
        return np.divide(v, size, out=np.zeros_like(v), where=size > 0)

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        out = [pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        if len(held) and len(asked):
            ids, own = held["vec_id"].to_numpy(), asked["query_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, found, units = ids[order], unit(held["embedding"])[order].T, unit(asked["query_vector"])
            if same:
                a, b = (t[same].to_numpy() for t in (asked, held))
            for i in range(0, len(own), PIECE):
                score = np.round(units[i : i + PIECE] @ found, 6) + 0.0
                if same:
                    score[a[i : i + PIECE, None] != b[order][None, :]] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(score, top, 1)
                at, place = np.nonzero(best > -np.inf)
                out.append(pa.table({"query_id": own[i + at], "vec_id": ids[top[at, place]], "score": best[at, place]}))
        return pa.concat_tables(out)

    return run


def met_by(held: DataFrame, asked: DataFrame, keys: list[str], k: int, same: str | None) -> DataFrame:
    """query_id, vec_id, score of the k best of each group: held (vec_id, embedding) and asked (query_id, query_vector) meet by
    keys. A group is a block of vectors and about BLOCK_QUERIES queries at most, however many groups a task has."""
    both = held.groupBy(*keys).cogroup(asked.groupBy(*keys))
    return both.applyInArrow(best_of_group(k, same), "query_id long, vec_id long, score double")


def query_groups(n: int) -> int:
    return max(1, -(-n // BLOCK_QUERIES))


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, same: str | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, vec_id, score, rank: the k vectors of highest cosine, exactly, for any number of queries
    (query_id, query_vector). Scores are rounded to 6 places, ties go to the smaller id.

    Queries meet blocks of vectors, and a task gives each query's k best of a block. same
    names a column of numbers of both tables in which hits equal their query; null equals nothing.
    Rows without an id, and vectors that are null or empty or hold a null or a non-finite number,
    take no part; vectors of another length than the query's are no candidates.
    """
    more = [same] if same else []
    asked = usable(queries, "query_id", "query_vector", *more)
    held = usable(vectors, vec_id, embedding, *more).withColumnsRenamed({vec_id: "vec_id", embedding: "embedding"})
    n, groups = max(1, -(-held.count() // BLOCK_VECTORS)), query_groups(asked.count())
    upto = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = asked.withColumns({"dim": F.size("query_vector"), "q": _block(F.col("query_id"), groups)}).withColumn("b", upto(n))
    held = held.withColumns({"dim": F.size("embedding"), "b": _block(F.col("vec_id"), n)}).withColumn("q", upto(groups))
    to = lambda c: F.col(c).cast("int").alias(c)
    asked, held = asked.select("dim", to("b"), to("q"), "query_id", "query_vector", *more), held.select("dim", to("b"), to("q"), "vec_id", "embedding", *more)
    scored = met_by(held, asked, ["dim", "b", "q"], k, same)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def normalized(hits: DataFrame, score: str = "score", to: str = "normalized") -> DataFrame:
    """Scores over the query's highest; all 0 if that is not positive."""
    most = F.max(score).over(Window.partitionBy("query_id"))
    return hits.withColumn(to, F.when(most <= 0, 0.0).otherwise(F.col(score) / most))


def fused(dense_hits: DataFrame, sparse_hits: DataFrame, k: int = 20) -> DataFrame:
    """query_id, id, dense_score, bm25_score, hybrid_score, rank of two lists of hits (query_id, id, score, rank).

    Normalised scores are weighted; ties keep the dense order, then the sparse one.
    """
    d = normalized(dense_hits).select("query_id", "id", F.col("score").alias("dense_score"), F.col("normalized").alias("d"), F.col("rank").alias("d_rank"))
    s = normalized(sparse_hits).select("query_id", "id", F.col("score").alias("bm25_score"), F.col("normalized").alias("s"), F.col("rank").alias("s_rank"))
    both = d.join(s, ["query_id", "id"], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = both.withColumn("hybrid_score", F.round(DENSE_WEIGHT * zero("d") + SPARSE_WEIGHT * zero("s"), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), F.asc_nulls_last("d_rank"), F.asc_nulls_last("s_rank"))
    both = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return both.select("query_id", "id", zero("dense_score").alias("dense_score"), zero("bm25_score").alias("bm25_score"), "hybrid_score", "rank")


def reranked(hits: DataFrame, score: Column, k: int = 5) -> DataFrame:
    """hits (query_id, rank, …) by another score, ties by the former rank: final_score, rank_after."""
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "rank")
    out = hits.withColumn("final_score", F.round(score, 6)).withColumn("rank_after", F.row_number().over(order))
    return out.where(F.col("rank_after") <= k)


def overlap(query: Column | str, text: Column | str) -> Column:
    """Part of the query's distinct tokens that the text holds: the offline stand-in of a reranking model."""
    return shared_part(F.array_distinct(tokens(query)), F.array_distinct(tokens(text)))


def shared_part(q: Column, t: Column) -> Column:
    """overlap, of the distinct tokens themselves."""
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)


def demoted(hits: DataFrame, is_component: Column, names_component: Column) -> DataFrame:
    """Hits on components last, if the query names none but the top hit is one and others are not: new_rank."""
    w = Window.partitionBy("query_id")
    rows = hits.withColumns({"c_": is_component, "q_": names_component})
    top = F.max(F.when(F.col("rank") == 1, F.col("c_"))).over(w)
    moved = F.coalesce(top, F.lit(False)) & ~F.col("q_") & F.col("c_")
    return rows.withColumn("m_", moved).withColumn("new_rank", F.row_number().over(w.orderBy("m_", "rank"))).drop("c_", "q_", "m_")


def kept_or_all(hits: DataFrame, match: Column) -> DataFrame:
    """The matching hits of each query; all of them where none matches. Stands above the k cut."""
    rows = hits.withColumn("m_", F.coalesce(match, F.lit(False)))
    rows = rows.withColumn("any_", F.max("m_").over(Window.partitionBy("query_id")))
    return rows.where(F.col("m_") | ~F.col("any_")).drop("m_", "any_")


def trace(hits: DataFrame, before: str, after: str) -> DataFrame:
    """query_id, passage_count and the highest scores before and after reranking."""
    top = lambda c: F.slice(F.sort_array(F.collect_list(c), False), 1, 5)
    return hits.groupBy("query_id").agg(F.count("*").alias("passage_count"), top(before).alias("top_5_before"), top(after).alias("top_5_after"), F.max(before).alias("max_before"), F.max(after).alias("max_after"))


def refusal(queries: DataFrame, hits: DataFrame, threshold: float = 0.2, high: float = 0.5, least: int = 2) -> DataFrame:
    """query_id, refuse, reason, high_count and refuse_by_count from hits' final_score."""
    s = hits.groupBy("query_id").agg(F.max("final_score").alias("m"), F.count_if(F.col("final_score") > high).alias("high_count"))
    rows = queries.select("query_id").join(s, "query_id", "left")
    reason = F.when(F.col("m").isNull(), "No passages retrieved").when(F.col("m") < threshold, "Low confidence").otherwise("")
    return rows.select("query_id", (reason != "").alias("refuse"), reason.alias("reason"), F.coalesce("high_count", F.lit(0)).alias("high_count"), (F.coalesce("high_count", F.lit(0)) < least).alias("refuse_by_count"))
