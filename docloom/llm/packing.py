"""Packing token pieces into sequences by bin completion.

Only the lengths of pieces matter for a packing, and there are at most `capacity` of them. So the
plan is made on the counts of lengths: around the largest length left, undominated fillings of the
rest are enumerated, best fit first; the filling taken is used as often as the counts allow, and a
branch-and-bound over the choices stops at the lower bound or prunes by the waste that a better
solution could still afford. The pieces are then numbered within their length (in salted groups, so
that a length that a third of all pieces share does not meet in one task) and number ranges tell
each its sequence and place. The driver holds counts of lengths and filling patterns, no pieces.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.bpe import Bounded, byte_symbols
from docloom.llm.scratch import Scratch, literal_table
from docloom.llm.wordhash import held, text_slices

CAPACITY, END_ID = 4096, 1
SALTS = 64
#: Choices tried at a bin, fillings seen in one enumeration, bins opened by the search over all bins.
BRANCHES, FILL_NODES, SEARCH_NODES = 3, 400, 6_000
CACHE_WORDS = 1 << 18
# fixed value: the split pattern of the vocabulary
_PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words that Unicode normalisation leaves alone, so that the library's model can take their parts as they are.
_EASY = regex.compile("[!-~\xa1-\u012f\u0132-\u024f]+")


def dominated(small: tuple[int, ...], large: tuple[int, ...]) -> bool:
    """Whether the items of small can be put into the items of large (Martello and Toth)."""
    room = list(large)

    def place(k: int) -> bool:
        if k == len(small):
            return True
        for j, free in enumerate(room):
            if free >= small[k] and free not in room[:j]:
                room[j] -= small[k]
                if place(k + 1):
                    return True
                room[j] += small[k]
        return False

    return sum(small) <= sum(large) and place(0)


def fillings(space: int, sizes: list[int], count: dict[int, int]) -> list[tuple[int, ...]]:
    """Undominated maximal fillings of space, best fit first, larger items first among equals.

    sizes: ascending, those with a count. A step of the enumeration takes so many items of one size,
    many first, and goes on with smaller sizes, so that its depth is the number of sizes, not of
    items. It ends at FILL_NODES steps or BRANCHES fillings without waste.
    """
    found: list[tuple[tuple[int, int], ...]] = []
    nodes = perfect = 0

    def maximal(rest: int, taken: dict[int, int]) -> bool:
        return all(count[s] <= taken.get(s, 0) for s in sizes[: bisect_right(sizes, rest)])

    def fill(space: int, upto: int, taken: tuple[tuple[int, int], ...]) -> None:
        nonlocal nodes, perfect
        at, grown = bisect_right(sizes, space, 0, upto), False
        while at > 0 and nodes < FILL_NODES and perfect < BRANCHES:
            at -= 1
            size = sizes[at]
            for k in range(min(count[size], space // size), 0, -1):
                grown = True
                fill(space - k * size, at, (*taken, (size, k)))
                if nodes >= FILL_NODES or perfect >= BRANCHES:
                    break
        if not grown:
            nodes += 1
            if not found or maximal(space, dict(taken)):
                found.append(taken)
                perfect += space == 0

    fill(space, len(sizes), ())
    out: list[tuple[int, ...]] = []
    flat = [tuple(s for s, k in f for _ in range(k)) for f in dict.fromkeys(found)]
    for f in sorted(flat, key=lambda f: (-sum(f), len(f), [-x for x in f])):
        # pairs of fillings of more items are not compared: a dominated one costs a try, no sequence
        if not any(len(f) <= 8 and len(g) <= 8 and dominated(f, g) for g in out):
            out.append(f)
        if len(out) == BRANCHES:
            break
    return out or [()]


def _descend(count: dict[int, int], capacity: int, choices: list[int], allowed: int) -> tuple[list[tuple[tuple[int, ...], int]], list[int], bool]:
    """One way down the tree: at bin k the filling number choices[k] (0 beyond). Stops where the
    waste exceeds allowed. Returns patterns with their uses, how many choices each step had, and
    whether it reached the end."""
    left, sizes, plan, width, waste = dict(count), sorted(count), [], [], 0
    while sizes:
        top = sizes[-1]
        left[top] -= 1
        options = fillings(capacity - top, sizes if left[top] else sizes[:-1], left)
        left[top] += 1
        pick = choices[len(plan)] if len(plan) < len(choices) else 0
        width.append(len(options))
        pattern = (top, *options[min(pick, len(options) - 1)])
        need = Counter(pattern)
        uses = min(left[s] // k for s, k in need.items())
        waste += (capacity - sum(pattern)) * uses
        if waste > allowed:
            # the last bins of all may be partly empty; what is left then counts as waste only once
            rest = sum(s * c for s, c in left.items()) - sum(pattern) * uses
            if rest > 0:
                return plan, width, False
        for s, k in need.items():
            left[s] -= k * uses
        sizes = [s for s in sizes if left[s] > 0]
        plan.append((pattern, uses))
    return plan, width, True


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of best-fit decreasing, by counts: the first incumbent."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []
    full: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], uses: int, free: int) -> None:
        if not free:
            full.append((pattern, uses))
            return
        if free not in room:
            insort(spaces, free)
            room[free] = []
        room[free].append((pattern, uses))

    for size in sorted(count, reverse=True):
        n = count[size]
        while n:
            at = bisect_left(spaces, size)
            if at < len(spaces):
                free = spaces[at]
                pattern, have = room[free].pop()
                each, uses = 1, min(n, have)
                if have > uses:
                    room[free].append((pattern, have - uses))
                if not room[free]:
                    del room[free], spaces[at]
            else:
                pattern, free, each = (), capacity, min(capacity // size, n)
                uses = n // each
            n -= uses * each
            put(pattern + (size,) * each, uses, free - size * each)
    return full + [x for found in room.values() for x in found]


def complete_bins(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence) with their uses, in as few sequences as found."""
    total = sum(s * c for s, c in count.items())
    if not total:
        return []
    least = max(-(-total // capacity), sum(c for s, c in count.items() if 2 * s > capacity))
    first, width, _ = _descend(count, capacity, [], total * capacity)
    plan = min(first, best_fit(count, capacity), key=lambda p: sum(u for _, u in p))
    best, spent = sum(u for _, u in plan), len(first)
    stack = [[0] * k + [c] for k in range(len(width)) for c in range(1, width[k])]
    while stack and best > least and spent < SEARCH_NODES:
        choices = stack.pop()
        other, wide, ended = _descend(count, capacity, choices, (best - 1) * capacity - total)
        spent += len(other) + 1
        if ended and sum(u for _, u in other) < best:
            plan, best = other, sum(u for _, u in other)
        stack += [choices + [0] * (k - len(choices)) + [c] for k in range(len(choices), min(len(wide), len(choices) + 2)) for c in range(1, wide[k])]
    return plan


class _Words(Bounded):
    """Ids of words that white space bounds."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        super().__init__(CACHE_WORDS // 2)
        self.whole = Tokenizer.from_str(content)
        self.parts = _Parts(self.whole.model)

    def make(self, word: bytes) -> bytes:
        text = word.decode()
        if _EASY.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.parts.__getitem__, _PART.findall(text.lower())))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class _Parts(Bounded):
    """Ids of what the vocabulary's split pattern makes of a word, from the library's model alone."""

    def __init__(self, model):
        super().__init__(CACHE_WORDS // 2)
        self.model, self.symbols = model, byte_symbols()

    def make(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join(self.symbols[b] for b in part.encode())
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, cut every capacity tokens.

    The vocabulary at path drops white space, so that words apart at ASCII white space are encoded
    apart and remembered. A null text counts as empty.
    """
    with open(path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held(("words", hash(content.value)), lambda: _Words(content.value)).__getitem__
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for row, offsets, data in text_slices(batch.column(1)):
                whole, at, out = data.tobytes(), offsets.tolist(), []
                for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    body = whole[a:b]
                    # strings of special tokens are looked for before letters are lowered
                    ids = b"".join(map(of, (body if b"<|" in body else body.lower()).split())) + end
                    out += [(row + i, k, part) for k in range(-(-len(ids) // (4 * capacity))) for part in (ids[4 * capacity * k : 4 * capacity * (k + 1)],)]
                length = np.array([len(p) // 4 for _, _, p in out], np.int64)
                piece = np.array([k for _, k, _ in out], np.int32)
                columns = [
                    batch.column(0).take(pa.array([i for i, _, _ in out], pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity),
                    pa.array(length), pa.array([zlib.crc32(p) for _, _, p in out], pa.int64()),
                ]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), pa.array(np.frombuffer(b"".join(p for _, _, p in out), "<u4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with doc_id, piece and length) with sequence_id and offset, sequences gapless from 0.

    Lengths are 1 to capacity. Ids may repeat or be null. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    salted = scratch.keep(pieces.withColumn("salt_", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")), "pieces")
    counts = scratch.keep(salted.groupBy("length", "salt_").agg(F.count("*").alias("n_")), "counts")
    # at most capacity rows
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n_").alias("n")).collect()}
    ranges, used, first = [], dict.fromkeys(by_length, 0), 0
    for pattern, uses in complete_bins(by_length, capacity):
        at = 0
        for size, each in sorted(Counter(pattern).items(), reverse=True):
            ranges.append((size, used[size], used[size] + each * uses, each, first, at))
            used[size] += each * uses
            at += each * size
        first += uses
    # of the order of capacity rows: each pattern uses up a length or the space of another pattern
    frame = literal_table(spark, ranges, "length_ from_ to_ each_ first_ at_")
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("length").orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "salt_", before.alias("before_"))
    inside = F.row_number().over(Window.partitionBy("length", "salt_").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("inside_", inside).join(starts, ["length", "salt_"]).withColumn("k_", F.col("before_") + F.col("inside_") - 1)
    placed = ranked.join(F.broadcast(frame), (F.col("length") == F.col("length_")) & (F.col("k_") >= F.col("from_")) & (F.col("k_") < F.col("to_")))
    k = F.col("k_") - F.col("from_")
    placed = placed.withColumn("sequence_id", F.col("first_") + F.floor(k / F.col("each_"))).withColumn("offset", F.col("at_") + k % F.col("each_") * F.col("length"))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for all pieces of docs.

    Null and empty texts are the end id alone. Other columns of docs play no part.
    """
    return pack(token_pieces(docs, path, capacity, end_id), capacity)
