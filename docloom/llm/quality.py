"""Quality rules as a short-circuit cascade.

Each rule needs some features of a text. On a bounded sample the operator measures what each
rule's features cost and how many texts the rule rejects, and orders the rules by rejections per
second of cost; then every text passes the rules in that order and leaves at the first one that
rejects it, so that the costly features are computed only for texts that the cheap, selective
rules let through. The order changes the time, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.wordhash import let_go, mix, text_slices, windows, word_hashes, words

#: Rows on which costs and rejections are measured, and the most bytes that a text of them has.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 1 << 16
WINDOW = 8
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_IS_START = (np.arange(256) & 0xC0) != 0x80


class Stretch:
    """Rows of texts; features are computed when first asked for."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.offsets, self.data, self.found = offsets, data, {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, feature: str) -> np.ndarray:
        if feature not in self.found:
            self.found[feature] = FEATURES[feature](self)
        return self.found[feature]

    def of(self, keep: np.ndarray) -> Stretch:
        """The rows where keep holds, with what is known of them."""
        size = np.diff(self.offsets)
        out = Stretch(np.concatenate([[0], np.cumsum(size[keep])]), self.data[np.repeat(keep, size)])
        out.found = {k: v[keep] for k, v in self.found.items() if k != "words"}
        return out


def _words(x: Stretch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "words" not in x.found:
        x.found["words"] = words(x.offsets, x.data)
    return x.found["words"]


def _sums(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[cuts])


def _word_chars(x: Stretch) -> np.ndarray:
    starts, ends, first = _words(x)
    points = np.concatenate([[0], np.cumsum(_IS_START[x.data], dtype=np.int64)])
    return _sums(points[ends] - points[starts], first)


def _dup_lines(x: Stretch) -> np.ndarray:
    whole, out = x.data.tobytes(), np.zeros(len(x), np.int64)
    for i, (a, b) in enumerate(zip(x.offsets[:-1].tolist(), x.offsets[1:].tolist(), strict=True)):
        lines = [line for line in whole[a:b].split(b"\n") if line.strip()]
        out[i] = len(lines) - len(set(lines))
    return out


def _repeat_words(x: Stretch) -> np.ndarray:
    starts, ends, first = _words(x)
    hashes = windows(word_hashes(x.data, starts, ends, fold=False), WINDOW)
    row = np.repeat(np.arange(len(x)), np.diff(first))
    at = np.flatnonzero(row[: len(hashes)] == row[WINDOW - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    key = mix(hashes[at] ^ mix(row[at].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(at) else at
    edge = np.zeros(len(row) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, np.minimum(twice + WINDOW, len(row)), -1)
    return _sums(np.cumsum(edge[:-1]) > 0, first)


def _stutters(x: Stretch) -> np.ndarray:
    starts, ends, first = _words(x)
    hashes = word_hashes(x.data, starts, ends, fold=False)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][first[:-1] < len(same)]] = False
    return _sums(same, first)


#: What a rule can ask for; each gives one whole number for a row.
FEATURES: dict[str, Callable[[Stretch], np.ndarray]] = {
    "n_words": lambda x: np.diff(_words(x)[2]).astype(np.int64),
    "word_chars": _word_chars,
    "n_symbols": lambda x: _sums(_IS_SYMBOL[x.data], x.offsets),
    "n_dup_lines": _dup_lines,
    "n_lines": lambda x: _sums(x.data == 10, x.offsets) + 1,
    "n_repeat_words": _repeat_words,
    "n_stutters": _stutters,
}


@dataclass(frozen=True)
class Rule:
    """rejects: from a Stretch to True for each row that the rule turns away."""

    name: str
    rejects: Callable[[Stretch], np.ndarray]


def base_rules() -> list[Rule]:
    """Fewer than 20 words; more than 30 % of the words in repeated windows of 8."""
    return [
        Rule("few_words", lambda x: x["n_words"] < 20),
        Rule("repeated_words", lambda x: 100 * x["n_repeat_words"] > 30 * x["n_words"]),
    ]


def default_rules() -> list[Rule]:
    """The base rules; more than one symbol to ten words; words of under 2 or over 12 code points on
    average; at least three repeated lines that are over 30 % of the lines; over 30 % of the words
    equal to the word before. All in whole numbers."""
    return [
        *base_rules(),
        Rule("symbols", lambda x: 10 * x["n_symbols"] > x["n_words"]),
        Rule("word_length", lambda x: (x["word_chars"] < 2 * x["n_words"]) | (x["word_chars"] > 12 * x["n_words"])),
        Rule("repeated_lines", lambda x: (x["n_dup_lines"] >= 3) & (100 * x["n_dup_lines"] > 30 * x["n_lines"])),
        Rule("stutter", lambda x: 100 * x["n_stutters"] > 30 * x["n_words"]),
    ]


def ordered(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second of cost on the first sample_rows rows that the scan gives, of
    texts of at most SAMPLE_BYTES. Spark reads only as many partitions as it takes to find them, and
    the driver measures them: no exchange, and a bounded number of bytes."""
    body = F.col(f"`{text}`").cast("string")
    sample = docs.select(body.alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).limit(sample_rows).toArrow()
    spent, gone = [0.0] * len(rules), [0] * len(rules)
    for batch in sample.to_batches():
        for _, offsets, data in text_slices(batch.column(0)):
            for k, rule in enumerate(rules):
                began = time.perf_counter()
                gone[k] += int(rule.rejects(Stretch(offsets, data)).sum())
                spent[k] += time.perf_counter() - began
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-gone[k] / max(spent[k], 1e-9), k))]


def _cascade(rules: list[Rule], report: list[str], always: list[Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            kept, failed, extra = [], [], [[] for _ in report]
            for _, offsets, data in text_slices(batch.column(1)):
                whole = Stretch(offsets, data)
                if report:
                    # a report asks for these of every row, so that the rules take them from it
                    for k, name in enumerate(report):
                        extra[k].append(whole[name])
                    failed.append(np.logical_or.reduce([rule.rejects(whole) for rule in always]))
                rows, left = np.arange(len(whole)), whole
                ok = np.ones(len(whole), bool)
                for rule in rules:
                    bad = rule.rejects(left)
                    ok[rows[bad]] = False
                    if bad.any():
                        rows = rows[~bad]
                        left = left.of(~bad)
                    if not len(rows):
                        break
                kept.append(ok)
            join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            out = [batch.column(0), *(pa.array(join(e, np.int64), pa.int64()) for e in extra)]
            if report:
                out.append(pa.array(join(failed, bool), pa.bool_()))
            yield pa.RecordBatch.from_arrays([*out, pa.array(join(kept, bool), pa.bool_())], names=["id", *report, *["base_failed"] * bool(report), "kept"])

    return run


def judge(docs: DataFrame, rules: list[Rule] | None = None, report: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and kept for every row; with report also these features and base_failed, for all rows.

    A null text counts as empty: it has no words and fails the first base rule. Ids may repeat or be
    null; they are carried only. Other columns play no part. An empty table gives an empty result.
    """
    chosen = ordered(docs, rules or default_rules(), text)
    fields = ", ".join(["id long", *(f"{x} long" for x in report or []), *["base_failed boolean"] * bool(report), "kept boolean"])
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_cascade(chosen, report or [], base_rules()), fields).withColumnRenamed("id", doc_id)


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows of docs that pass all rules, with all their columns and no shuffle."""
    chosen = ordered(docs, rules or default_rules(), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdict = _cascade(chosen, [], [])
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            pair = pa.RecordBatch.from_arrays([pa.nulls(len(column), pa.int64()), column], names=["id", "text"])
            yield from (batch.filter(x.column(1)) for x in verdict([pair]))

    return docs.mapInArrow(run, docs.schema)
