"""Sharding by histogram sort.

Rows are ordered by (hash of the text, id), so equal texts stand together. Splitters that give
shards of near equal bytes are found without moving rows: in each round the exact bytes and rows
below evenly spaced candidate boundaries are counted across all partitions (one pre-aggregated
count over a slim table), and the cells that hold a splitter, or too many rows for one task, get
new boundaries inside them. A cell of a single hash, as a large group of copies makes, is split by
id. When the splitters meet the tolerance, rows are exchanged once, by cell; their places follow
from the counts of the cells before and a row number inside the cell.

Main path: DataFrame functions only. The driver holds cells, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.scratch import Scratch, literal_table

FIRST_BITS, STEP_BITS = 10, 6
#: A splitter may miss its place by this part of a shard's bytes.
TOLERANCE = 0.0005
#: A cell of more than rows / CELLS rows, or of more than MOST_ROWS, is split further: one task numbers a cell.
CELLS, MOST_ROWS = 512, 1 << 20
#: But none of fewer rows than this.
LEAST_ROWS = 256


@dataclass(frozen=True)
class Cell:
    """Rows with lo <= hash < lo + width and, if width is 1, id_lo <= id < id_lo + id_width."""

    lo: int
    width: int
    id_lo: int | None
    id_width: int
    rows: int
    size: int

    @property
    def key(self) -> tuple[int, int]:
        return self.lo, -(2**64) if self.id_lo is None else self.id_lo


def _count(slim: DataFrame, open_cells: list[Cell], spark) -> list[Cell]:
    """The open cells cut into parts, with the exact rows and bytes of each that is not empty."""
    parts = []
    for k, c in enumerate(open_cells):
        by_id = c.width == 1
        span = c.id_width if by_id else c.width
        step = max(1, -(-span // (1 << STEP_BITS)))
        parts.append((k, c.lo >> 64 - FIRST_BITS, c.lo, c.lo + c.width - 1, c.id_lo if by_id else None, c.id_lo + c.id_width - 1 if by_id else None, step, c.lo if not by_id else c.id_lo, by_id))
    frame = literal_table(spark, parts, "cell p lo hi id_lo id_hi step start by_id")
    # a cell lies in one of the first ones, so that the join has a key
    inside = (F.shiftright("h", 64 - FIRST_BITS) == F.col("p")) & F.col("h").between(F.col("lo"), F.col("hi")) & (~F.col("by_id") | F.col("t").between(F.col("id_lo"), F.col("id_hi")))
    at = F.when(F.col("by_id"), F.col("t")).otherwise(F.col("h")).cast("decimal(20,0)") - F.col("start")
    counted = (
        slim.join(F.broadcast(frame), inside)
        .groupBy("cell", F.floor(at / F.col("step").cast("decimal(20,0)")).cast("long").alias("part"))
        .agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
        .collect()
    )
    out = []
    for r in counted:
        c = open_cells[r["cell"]]
        step = int(parts[r["cell"]][6])
        if c.width == 1:
            lo = c.id_lo + r["part"] * step
            out.append(Cell(c.lo, 1, lo, min(step, c.id_lo + c.id_width - lo), r["rows"], r["size"]))
        else:
            lo = c.lo + r["part"] * step
            out.append(Cell(lo, min(step, c.lo + c.width - lo), None, 0, r["rows"], r["size"]))
    return out


def _cells(slim: DataFrame, shards: int, tolerance: float) -> list[Cell]:
    spark = slim.sparkSession
    first = slim.groupBy(F.shiftright("h", 64 - FIRST_BITS).alias("p")).agg(F.count("*").alias("rows"), F.sum("size").alias("size")).collect()
    width = 1 << (64 - FIRST_BITS)
    cells = [Cell(r["p"] * width, width, None, 0, r["rows"], r["size"]) for r in first]
    total, rows = sum(c.size for c in cells), sum(c.rows for c in cells)
    ends = None
    while True:
        cells.sort(key=lambda c: c.key)
        marks = [total * k / shards for k in range(1, shards)]
        still, below, open_cells = [], 0, []
        for c in cells:
            holds = any(below < m < below + c.size for m in marks)
            wide = holds and c.size > tolerance * total / shards or c.rows > min(MOST_ROWS, max(LEAST_ROWS, rows / CELLS))
            fixed = c.width == 1 and c.id_lo is not None and c.id_width <= 1
            (open_cells if wide and c.rows > 1 and not fixed else still).append(c)
            below += c.size
        if not open_cells:
            return cells
        single = [c for c in open_cells if c.width == 1 and c.id_lo is None]
        if single:
            # ids below all others stand for null
            ends = slim.where(F.col("h").isin([c.lo for c in single])).groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b")).collect()
            span = {r["h"]: (r["a"], r["b"] - r["a"] + 1) for r in ends}
            open_cells = [c if c not in single else Cell(c.lo, 1, *span[c.lo], c.rows, c.size) for c in open_cells]
        flat = [c for c in open_cells if c.width == 1 and c.id_width <= 1]
        cells = still + flat + _count(slim, [c for c in open_cells if c not in flat], spark)


def _plan(cells: list[Cell], shards: int) -> list[tuple[Cell, int, int]]:
    """Each cell with its shard and its first place there; a splitter is the cell edge nearest to its mark."""
    total, below, out, used = sum(c.size for c in cells), 0, [], [0] * shards
    shard = 0
    for c in cells:
        while shard < shards - 1 and below + c.size / 2 > total * (shard + 1) / shards:
            shard += 1
        out.append((c, shard, used[shard]))
        used[shard] += c.rows
        below += c.size
    return out


def shard_by_bytes(rows: DataFrame, key_hash: str, tie: str, size: str, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    key_hash is a 64-bit hash column (rows of equal hash stand together, split only where a large
    group would upset the bytes), tie a long column that orders them, null first, and size a
    positive number of bytes. Rows that agree in both are told apart by nothing and may lie in one
    cell however many they are; their slots differ all the same. An empty table gives an empty
    result. Every column of rows is carried; two named shard or slot are replaced.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "shards")
    null_tie = F.coalesce(F.col(tie), F.lit(-(2**63)))
    slim = scratch.keep(rows.select(F.col(key_hash).alias("h"), null_tie.alias("t"), F.col(size).cast("long").alias("size")), "slim")
    plan = _plan(_cells(slim, shards, tolerance), shards)
    scratch.drop("slim")
    # the first cells, 64 for each that was opened, and one for each MOST_ROWS rows
    shift = 64 - FIRST_BITS
    found = [(c.lo >> shift, c.lo, c.lo + c.width - 1, c.id_lo, None if c.id_lo is None else c.id_lo + c.id_width - 1, k, shard, first) for k, (c, shard, first) in enumerate(plan)]
    frame = literal_table(spark, found, "p_ lo_ hi_ a_ b_ cell_ shard_ first_")
    carried = [c for c in rows.columns if c not in ("shard", "slot")]
    # the rows are one column, so that their names do not meet those of the cells
    whole = rows.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), F.col(f"`{key_hash}`").alias("h"), null_tie.alias("t"))
    at = (F.shiftright("h", shift) == F.col("p_")) & F.col("h").between(F.col("lo_"), F.col("hi_")) & (F.col("a_").isNull() | F.col("t").between(F.col("a_"), F.col("b_")))
    placed = whole.join(F.broadcast(frame), at)
    inside = F.row_number().over(Window.partitionBy("cell_").orderBy("h", "t"))
    return placed.select("row", F.col("shard_").cast("int").alias("shard"), (F.col("first_") + inside - 1).alias("slot")).select(*(F.col(f"row.`{c}`").alias(c) for c in carried), "slot", "shard")


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs with size (UTF-8 bytes of the text, none for null, plus 1), shard and slot.

    Null and empty texts are one group. Columns of docs named size, shard or slot are replaced.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    carried = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("doc"), F.col(f"`{doc_id}`").cast("long").alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.xxhash64(body).alias("hash"))
    placed = shard_by_bytes(sized, "hash", "id", "size", shards)
    return placed.select(*(F.col(f"doc.`{c}`").alias(c) for c in carried), "size", "slot", "shard")
