"""Repair of conversations: a Viterbi pass over a grammar of four states.

The roles of a sound conversation are a system turn or none, and then pairs of a user's and an
assistant's turn. States: nothing yet, after the system turn, after a user's turn (an answer is due),
after an assistant's turn. Each turn is kept, given another role, or deleted, and empty turns may be
inserted anywhere. A state carries the least (cost, audit) of all edits that lead to it, and the
audit, the initials of the edits, decides among equal costs; after each turn the layer is closed by
inserts, two at most, as a third would lead back to a state at a higher cost.

One exchange brings the turns of a conversation together, in order, and a task reads them as a
stream: it holds four short states and no conversation. Whether a turn repeats an earlier one is a
window of the same exchange. A state holds the end of its audit only, from where the four part, and
a running digest of the repaired turns; so a conversation of any length is bounded by its audit,
which is a part of the result. A digest is a sequence by nature: a conversation is one task's work.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
# fixed values: the grammar; what a state becomes by an initial, and what it asks for
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ASKED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
_ENDS = (0, 3)
#: After so many turns what all states' audits begin with is set aside.
SETTLE = 256
#: Characters that count as text, and ends of sentences.
SOLID, END = r"[^\x20\x09-\x0D]", "[.!?]"


class State(NamedTuple):
    """cost, the end of the audit, and the repaired turns: what `Turns.add` makes of them."""

    cost: int
    audit: str
    turns: object


class Digest:
    """The SHA-256 of the repaired turns, one `role:text` a line."""

    def __init__(self, inner=None, empty: bool = True):
        self.inner, self.empty = inner or hashlib.sha256(), empty

    def add(self, role: str, text: str) -> Digest:
        inner = self.inner.copy()
        inner.update((("" if self.empty else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        return Digest(inner, False)

    def result(self) -> str:
        return self.inner.hexdigest()


class Listed:
    """The repaired turns themselves, as a chain from the last back."""

    def __init__(self, before: Listed | None = None, turn: tuple[str, str] | None = None):
        self.before, self.turn = before, turn

    def add(self, role: str, text: str) -> Listed:
        return Listed(self, (role, text))

    def result(self) -> list[tuple[str, str]]:
        out, at = [], self
        while at.turn is not None:
            out.append(at.turn)
            at = at.before
        return out[::-1]


class Repair:
    """The layers of one conversation."""

    def __init__(self, turns):
        self.done: list[str] = []
        self.n = 0
        self.layer = self._closed({0: State(0, "", turns)})

    @staticmethod
    def _better(layer: dict[int, State], to: int, cost: int, audit: str) -> bool:
        return to not in layer or (cost, audit) < layer[to][:2]

    def _closed(self, layer: dict[int, State]) -> dict[int, State]:
        for _ in range(2):
            for state in list(layer):
                cost, audit, turns = layer[state]
                role, to = _ASKED[state]
                if self._better(layer, to, cost + INSERT, audit + "I"):
                    layer[to] = State(cost + INSERT, audit + "I", turns.add(role, ""))
        # a state that another serves as well, at a lower cost whatever follows, leads no best repair
        last = layer.get(3)
        if last:
            for state, more in ((0, DELETE), (1, 0)):
                if state in layer and last.cost + more < layer[state].cost:
                    del layer[state]
        return layer

    def turn(self, role: str, text: str, must_go: bool, cut: bool) -> None:
        layer: dict[int, State] = {}
        paths = []  # (cost, audit, state, from, role or None)
        for state, (cost, audit, _) in self.layer.items():
            paths.append((cost + DELETE, audit + "D", state, state, None))
            if not must_go:
                more = CUT if cut else 0
                to = _NEXT.get((state, role[:1]))
                if to is not None:
                    paths.append((cost + KEEP + more, audit + "K", to, state, role))
                asked, to = _ASKED[state]
                paths.append((cost + REROLE + more, audit + "R", to, state, asked))
        for cost, audit, to, state, said in sorted(paths, key=lambda p: p[:2]):
            if to not in layer:
                turns = self.layer[state].turns
                layer[to] = State(cost, audit, turns if said is None else turns.add(said, text))
        self.layer = self._closed(layer)
        self.n += 1
        if self.n % SETTLE == 0:
            common = os.path.commonprefix([s.audit for s in self.layer.values()])
            self.done.append(common)
            self.layer = {k: s._replace(audit=s.audit[len(common) :]) for k, s in self.layer.items()}

    def end(self) -> tuple[int, str, object]:
        cost, audit, turns = min((self.layer[s] for s in _ENDS if s in self.layer), key=lambda s: s[:2])
        return cost, "".join(self.done) + audit, turns.result()


def faults(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, gone: Column | None = None) -> DataFrame:
    """conv, at, role, text, gone, blank, duplicate, truncated in the order of each conversation's turns
    (nulls first, then by role and text), a task at a time. A turn has its first fault only. gone: rows
    that only name their conversation."""
    fill = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("at"), fill(role).alias("role"), fill(text).alias("text"), (F.lit(False) if gone is None else gone).alias("gone"))
    rows = rows.withColumn("blank", ~F.rlike("text", F.lit(SOLID)))
    seen = F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy("at")) > 1
    rows = rows.repartition("conv").withColumn("duplicate", ~F.col("blank") & seen)
    last = F.regexp_extract("text", f"({SOLID})[\\x20\\x09-\\x0D]*\\z", 1)
    rows = rows.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~F.rlike(last, F.lit(END)))
    return rows.sortWithinPartitions("conv", F.asc_nulls_first("at"), "role", "text")


class _Conversation:
    def __init__(self, turns):
        self.repair = Repair(turns)
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.before = None

    def add(self, at, role, text, gone, blank, duplicate, truncated) -> None:
        if gone:
            return
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if at is not None:
            self.distinct += at != self.high
            self.low = at if self.low is None else self.low
            self.high = at
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.repair.turn(role, text, blank or duplicate, truncated)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.end()


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _stream(kind, made: pa.DataType):
    names = ["conv", *(c.split()[0] for c in _COUNTS.split(", ")), "repaired"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for batch in batches:
            ended, of = [], batch.schema.field("conv").type
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for conv, *turn in zip(*columns, strict=True):
                if now is None or conv != at:
                    if now is not None:
                        ended.append((at, *now.result()))
                    at, now = conv, _Conversation(kind())
                now.add(*turn)
            if ended:
                yield out(ended, of)
        if now is not None:
            yield out([(at, *now.result())], of)

    def out(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        kinds = [of, *[pa.int64()] * 6, pa.string(), made]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def repaired(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None, digest: bool = False) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated and illegal (what is wrong
    with it), cost and audit (K keep, R another role, D delete, I insert) of its cheapest repair, and
    repaired, the turns (role, text) after it, or with digest their SHA-256.

    A null role or text is one space; a role is known by its initial. Turns are taken by turn, nulls
    first, equal ones by role and text. Blank turns (white space alone) and repeats of an earlier role
    and text are deleted; one that ends without `.`, `!` or `?` costs more unless deleted. gaps counts
    the numbers that are missing between the least and the greatest turn. gone marks rows that name
    their conversation and are no turns; a conversation of such rows alone has zeros and an empty
    audit. Rows with a null conv_id are one conversation. An empty table gives an empty result; other
    columns play no part.
    """
    rows = faults(turns, conv_id, turn, role, text, gone)
    kind = rows.schema["conv"].dataType.simpleString()
    shown = "string" if digest else "array<struct<role: string, text: string>>"

    def made() -> object:
        return Digest() if digest else Listed()

    out = rows.mapInArrow(_stream(made, pa.string() if digest else _TURNS), f"conv {kind}, {_COUNTS}, repaired {shown}")
    return out.withColumnRenamed("conv", conv_id)


def damaged(turns: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with gone: by the checksum of `conv_id:turn` a turn in
    twenty each is dropped (marked gone), emptied, stripped of `.!?`, repeated, and given to the user. Nulls
    are one space."""
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(fill("conv_id"), F.lit(":"), fill("turn"))) % 20
    rows = turns.select("conv_id", "turn", fill("role").alias("role"), fill("text").alias("text"), way.alias("way"))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", END, "")).otherwise(F.col("text"))
    times = F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("way") == 0).alias("gone"), F.explode(times).alias("copy"))
    return rows.drop("copy")
