"""Conversation repair, whitening and repeat removal against brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import repeats
from docloom.llm.repair import repaired
from docloom.llm.repeats import interval_tree, maximal_repeats, remove_repeats, repeat_groups
from docloom.llm.whitening import Moments, eigen, whiten

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def brute_repair(rows):
    """All edits of a few rows, in the order of their cost."""
    seen, kinds = set(), []
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    inserts = [()] + [x for n in (1, 2) for x in itertools.product(("user", "assistant"), repeat=n)]
    choices = []
    for (role, text), kind in zip(rows, kinds):
        own = [(4, "D", [])]
        if kind not in ("b", "d"):
            more = 3 if kind == "t" else 0
            own += [(more, "K", [(role, text)])] + [(3 + more, "R", [(r, text)]) for r in ("user", "assistant")]
        choices.append(own)
    for picks in itertools.product(*choices):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(p[0] for p in picks) + 3 * sum(map(len, gaps))
            audit = "".join("I" * len(g) + p[1] for g, p in zip(gaps, [*picks, (0, "", [])]))
            if best and (cost, audit) >= best[:2]:
                continue
            turns = [t for g, p in zip(gaps, [*picks, (0, "", [])]) for t in [(r, "") for r in g] + p[2]]
            if LEGAL.match("".join(r[:1] or "?" for r, _ in turns)):
                best = (cost, audit, turns)
    return [kinds.count(k) for k in "bdt"], best


def test_repair_is_the_cheapest_of_all_edits(spark):
    rng = random.Random(5)
    talks = {c: [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["Hi.", "So", " ", "Why?", "End. ", "x.\n"])) for _ in range(rng.randint(1, 3))] for c in range(40)}
    rows = [(c, t, role, text, "other") for c, talk in talks.items() for t, (role, text) in enumerate(sorted(talk))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string").withColumn("turn", F.lit(None).cast("long"))
    got = {r["conv_id"]: r for r in repaired(turns).collect()}
    assert len(got) == 40
    for c, talk in talks.items():
        counts, (cost, audit, made) = brute_repair(sorted(talk))
        r = got[c]
        assert [r["blank"], r["duplicate"], r["truncated"], r["cost"], r["audit"]] == [*counts, cost, audit], sorted(talk)
        assert [(x["role"], x["text"]) for x in r["repaired"]] == made and r["gaps"] == 0


def test_repair_of_long_conversations_nulls_and_dropped_rows(spark):
    n = 2000
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(n)] + [(None, None, None, None), (2, 5, "user", "a."), (2, 9, "assistant", "b."), (2, 9, "assistant", "b.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in repaired(turns, digest=True).collect()}
    text = "\n".join(f"{('user', 'assistant')[t % 2]}:Turn {t}." for t in range(n))
    assert got[1]["audit"] == "K" * n and got[1]["cost"] == 0 and got[1]["repaired"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[None]["audit"] == "D" and got[None]["blank"] == 1 and got[None]["repaired"] == hashlib.sha256(b"").hexdigest()
    assert got[2]["gaps"] == 3 and got[2]["duplicate"] == 1 and got[2]["audit"] == "KKD" and got[2]["illegal"] == 1
    none = {r["conv_id"]: r for r in repaired(turns.where("conv_id = 2"), gone=F.lit(True), digest=True).collect()}
    assert none[2]["audit"] == "" and none[2]["cost"] == 0 and none[2]["repaired"] == hashlib.sha256(b"").hexdigest()
    assert repaired(turns.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_eigenvalues_and_vectors(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, max(1, n // 2) if n == 7 else n))
    for matrix in (a @ a.T, np.eye(n), np.zeros((n, n)), np.diag(np.arange(n, dtype=float))):
        values, vectors = eigen(matrix)
        assert np.allclose(values, np.sort(np.linalg.eigvalsh(matrix))[::-1], atol=1e-10 * max(1, n))
        assert np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-11) and np.allclose((vectors.T * values) @ vectors, matrix, atol=1e-10 * max(1, n))


def test_merged_moments_are_those_of_all_rows():
    rows = np.random.default_rng(1).integers(-900, 900, (101, 5)).astype(float)
    state = Moments.none(5)
    for part in (rows[:1], rows[1:40], rows[40:40], rows[40:]):
        other = Moments.none(5)
        other.add(part)
        state.merge(other)
    assert state.n == 101 and np.allclose(state.mean, rows.mean(0)) and np.allclose(state.moments / 101, np.cov(rows.T, bias=True))


def test_whitening(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 4)) @ np.diag([3.0, 2.0, 1.0, 0.5])
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(vectors)]
    rows += [(900, None, ""), (901, [1.0, None, 0.0, 0.0], ""), (902, [1.0, math.inf, 0.0, 0.0], ""), (903, [math.nan] * 4, ""), (904, [], ""), (905, [1.0, 2.0], ""), (None, [0.5, 0.25, 0.0, 1.0], "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(7)
    got = whiten(table).collect()
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v, _ in [*rows[:300], rows[-1]]])
    n, sums = len(x), x.sum(0)
    values, _ = np.linalg.eigh(np.cov(x.T, bias=True))
    values = values[::-1]
    assert len(got) == n * 4 and {r["vec_id"] for r in got} == {*range(300), None}
    by = {(r["vec_id"], r["component"]): r for r in got}
    for i in (0, 7, 299):
        want = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums))
        assert all(by[i, k]["deviation"] == want and by[i, k]["n"] == n for k in range(1, 5))
    assert np.allclose([by[0, k]["explained"] for k in range(1, 5)], values / values.sum(), rtol=1e-9)
    made = np.array([[by[i, k]["whitened"] for k in range(1, 5)] for i in [*range(300), None]])
    assert np.allclose(np.cov(made.T, bias=True), np.eye(4), atol=1e-9) and got[0]["identity_error"] < 1e-9
    assert abs(made[0] @ made[0] - (x[0] - sums / n) @ np.linalg.inv(np.cov(x.T, bias=True)) @ (x[0] - sums / n)) < 1e-6
    assert whiten(table.limit(0)).collect() == [] and whiten(table.where("vec_id = 3")).collect() == []
    assert {r["component"] for r in whiten(table, most=2).collect()} == {1, 2}


def brute_removed(docs, least=50):
    """doc_id to (runs, rest) for distinct ids; None counts as least."""
    first = {}
    for i, text in docs:
        for k in range(len(text) - least + 1):
            w = text[k : k + least]
            first[w] = min(first.get(w, (True,)), (i is not None, i or 0)) if w in first else (i is not None, i or 0)
    out = []
    for i, text in docs:
        gone = [False] * len(text)
        for k in range(len(text) - least + 1):
            if first[text[k : k + least]] < (i is not None, i or 0):
                gone[k : k + least] = [True] * least
        runs = [(s, s + len(list(g))) for s, g in [(0, [])] if False]
        k = 0
        while k < len(text):
            if gone[k]:
                e = k
                while e < len(text) and gone[e]:
                    e += 1
                runs.append((k, e))
                k = e
            else:
                k += 1
        out.append((i, len(text), tuple(runs), bytes(b for b, g in zip(text, gone) if not g)))
    return out


def passages(rng, n):
    """Texts that share passages, with edits, low-entropy runs, copies and characters of several bytes."""
    stock = ["".join(rng.choice("abcd é中\n") for _ in range(rng.randint(30, 160))) for _ in range(6)] + ["-" * 90, "ab" * 60, "\x00" * 70]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(stock)
            if rng.random() < 0.4 and len(p) > 3:
                k = rng.randrange(len(p))
                p = p[:k] + "#" + p[k + rng.randint(0, 2) :]
            parts.append(p if rng.random() < 0.7 else "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 80))))
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("hot", [1024, 1])
def test_repeats_are_removed(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BLOCK", 4000)
    monkeypatch.setattr(repeats, "PIECE", 1000)
    monkeypatch.setattr(repeats, "GRAM_BUCKET", 4000)
    monkeypatch.setattr(repeats, "STRETCH_BUCKET", 2000)
    monkeypatch.setattr(repeats, "SORTED", 200)
    rng = random.Random(hot)
    texts = passages(rng, 60)
    docs = [(i if i != 59 else None, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(i, t, 7, "z") for i, t in docs] + [(100, None, 7, "z")], "doc_id long, text string, kept int, row string")
    got = sorted(((r["doc_id"], r["n_bytes"], tuple((x["start"], x["end"]) for x in r["spans"]), bytes(r["kept"])) for r in remove_repeats(table).collect()), key=str)
    want = sorted([*brute_removed([(i, t.encode()) for i, t in docs]), (100, 0, (), b"")], key=str)
    assert got == want
    assert remove_repeats(table).columns == ["doc_id", "row", "n_bytes", "spans", "kept"]


def test_rows_of_one_id_and_empty_tables(spark):
    text = "".join(random.Random(3).choice("abcdefgh") for _ in range(80))
    table = spark.createDataFrame([(1, text), (1, text + "x"), (2, "short"), (3, "y" + text)], "doc_id long, text string")
    got = sorted((r["doc_id"], sum(x["end"] - x["start"] for x in r["spans"])) for r in remove_repeats(table).collect())
    assert got == [(1, 0), (1, 0), (2, 0), (3, 80)]
    assert remove_repeats(table.limit(0)).collect() == []


def test_groups_hold_all_occurrences(spark):
    texts = passages(random.Random(9), 40)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in repeat_groups(table).collect():
        found.setdefault(r["group"], []).append((r["doc_id"], r["start"], r["length"]))
    raw = [t.encode() for t in texts]
    windows = {}
    for d, t in enumerate(raw):
        for k in range(len(t) - 49):
            windows.setdefault(t[k : k + 50], set()).add((d, k))
    covered = set()
    for places in found.values():
        strings = {raw[d][s : s + n] for d, s, n in places}
        assert len(strings) == 1
        whole = strings.pop()
        assert {(d, s) for d, s, _ in places} == {(d, k) for d, k in windows[whole[:50]] if raw[d][k : k + len(whole)] == whole}
        covered |= {whole[k : k + 50] for k in range(len(whole) - 49)}
    assert covered >= {w for w, at in windows.items() if len({d for d, _ in at}) > 1}


def test_interval_tree_and_left_extension():
    assert sorted(interval_tree([3, 5, 5, 0, 4], 3)) == [(3, 0, 3), (4, 4, 5), (5, 1, 3)]
    a, b = b"x" + b"q" * 3 + bytes(range(65, 120)), b"y" + b"q" * 3 + bytes(range(65, 120))
    group, length, string, place = maximal_repeats(np.frombuffer(a + b, np.uint8), np.array([len(a), len(b)]), np.array([False, False]), 50)
    assert sorted(zip(length.tolist(), string.tolist(), place.tolist())) == [(58, 0, 1), (58, 1, 1)] and len(set(group.tolist())) == 1
