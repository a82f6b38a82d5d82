import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import minhash
from docloom.llm.line_dedup import dedup_lines
from docloom.llm.minhash import band_keys, estimate, keep_one_of_each, near_duplicates, registers
from docloom.llm.wordhash import shingle_sets

SCHEMA = "doc_id long, text string, component_id string, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def sets_of(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    comp = {i: i for i, _ in rows}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, x in rows:
        for b, y in rows:
            s, t = sets_of(x), sets_of(y)
            if a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                p, q = sorted((top(a), top(b)))
                comp[q] = p
    return {i: top(i) for i, _ in rows}


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    base, rows = word(150), []
    for i in range(60):  # one large family at all distances
        copy = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 6)):
            copy[at] = f"e{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(word(int(rng.integers(1, 40))))) for i in range(30)]
    rows += [(200, rows[70][1].upper()), (201, "a b c"), (202, "A b  c"), (203, ""), (204, None), (205, "   "), (206, "b a c"), (207, " ".join(base[:140]))]
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    got = near_duplicates(frame(spark, rows), percent=85).collect()
    want = brute(rows, 85)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(sets_of(t)) for i, t in rows}


def test_null_ids_repeated_rows_and_empty_tables(spark):
    got = near_duplicates(frame(spark, [(None, "a b"), (5, "a b"), (5, "a b"), (7, "a b")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (5, 5, True), (5, 5, True), (7, 5, False)]
    assert near_duplicates(frame(spark, [])).count() == 0
    assert sorted(keep_one_of_each(frame(spark, [(1, "a b"), (2, "a b"), (3, "c")])).toPandas()["doc_id"]) == [1, 3]


def test_first_shingles_alone_leave_a_task(spark):
    """Copies of a core with own words, in two components: all pairs that can be linked meet, and common shingles stay."""
    rng = np.random.default_rng(6)
    core = [f"w{x}" for x in rng.integers(0, 9000, 200)]
    texts = {i: " ".join([*core[: 200 - 4 * (i % 12)], *(f"o{i % 24}x{k}" for k in range(4 * (i % 12))), f"e{i}"]) for i in range(96)}
    nodes = spark.createDataFrame([(i, i % 2) for i in texts], "node long, comp long")
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    written = {}
    scratch = minhash.Scratch(spark, "t")
    keep = scratch.keep
    scratch.keep = lambda df, name: written.setdefault(name, keep(df, name))
    got = {(r["a"], r["b"]) for r in minhash._prefix_pairs(scratch, nodes, rows, 5, 80).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    linked = {(a, b) for a in sets for b in sets if a < b and (b - a) % 2 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert linked and linked <= got
    assert "shingles" not in written and written["prefixes"].count() * 4 < sum(map(len, sets.values()))


@pytest.mark.parametrize("share", [0.5, 0.85, 0.95])
def test_estimate_is_near(share):
    rng = np.random.default_rng(1)
    both, n = rng.integers(0, 2**63, int(4000 * share), dtype=np.uint64), 4000 - int(4000 * share)
    a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, n, dtype=np.uint64)]) * np.uint64(2)) for _ in range(2))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(estimate(registers(a), registers(b), len(a), len(b))[0] - true) < 0.15
    assert (band_keys(registers(a)) == band_keys(registers(a))).all()


def test_texts_of_a_batch_stay_apart():
    found = list(shingle_sets(pa.array(["a b", None, "c", "", "a b", "A B"]), 5))
    assert [len(x) for x in found] == [1, 0, 1, 0, 1, 1] and found[0][0] == found[4][0] == found[5][0] != found[2][0]


def brute_lines(rows, percent=80):
    order = sorted((i, p, line) for i, t in rows for p, line in enumerate((t or "").split("\n")) if line.strip())
    tokens = [sets_of(x[2]) for x in order]
    gone = set()
    for k in range(len(order)):
        if any(100 * len(tokens[j] & tokens[k]) >= percent * len(tokens[j] | tokens[k]) for j in range(k)):
            gone.add(order[k][:2])
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}


def test_lines_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    lines = [" ".join(word(int(n))) for n in rng.integers(1, 70, 40)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(int(rng.integers(0, 8))):
            w = lines[int(rng.integers(0, len(lines)))].split()
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 9)}"
            own.append(" ".join(w))
        rows.append((i, "\n".join([*own, "", "  "])))
    rows += [(90, None), (91, ""), (92, "one"), (93, "ONE \n\none"), (94, "long " * 3000)]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)
    assert dedup_lines(frame(spark, [])).count() == 0


def test_unequal_lines_with_few_equal_shingles(spark):
    lines = ["- - - - -", "- - - - - - -", "a b a b a b", "b a b a b a", "a b a b a b a b", "Ha ha ha ha ha", "ha " * 9, "a b c " * 3, "a b c " * 5, "a b c d e f", "a b c d e", "- - - -", "- -", "x - - - - -"]
    rows = [(i, f"{x}\nown {i}") for i, x in enumerate(lines)] + [(50, "\n".join(lines))]
    want = brute_lines(rows)
    assert want[1] == "own 1" and want[3] == "own 3" and want[8] == "own 8" and want[9] != "own 9"
    assert {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, rows)).collect()} == want


def test_token_sets_of_lines_are_dealt_once(spark, monkeypatch):
    from docloom.llm.line_dedup import dedup_lines
    from docloom.scratch import Scratch

    kept, own = {}, Scratch.keep_bucketed

    def spy(self, df, table, buckets, by, order):
        kept[table] = (list(by), own(self, df, table, buckets, by, order))
        return kept[table][1]

    monkeypatch.setattr(Scratch, "keep_bucketed", spy)
    words = [f"w{i}" for i in range(24)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["x"])), (3, "other " + " ".join(words[::-1]))]
    out = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "", 3: rows[2][1]}
    by, sets = kept["sets"]
    plan = sets.groupBy("k1", "k2").count()._jdf.queryExecution().executedPlan().toString()
    assert by == ["k1", "k2"] and "Exchange" not in plan


def test_lines_that_share_a_phrase_make_no_pairs(spark, monkeypatch):
    """A phrase of many lines is no reason to pair them all; near copies among them are found all the same."""
    from docloom.llm import line_dedup

    found, own = [], line_dedup._possible

    def spy(pairs, percent):
        out = own(pairs, percent)
        found.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "_possible", spy)
    phrase = " ".join(f"p{i}" for i in range(12))
    lines = [f"{phrase} " + " ".join(f"w{i}x{j}" for j in range(14)) for i in range(60)]
    lines += [f"{lines[7]} end", f"start {lines[9]}"]
    rows = list(enumerate(lines))
    got = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == brute_lines(rows) and got[60] == got[61] == "" and got[7] and got[9]
    assert sum(found) <= 20


def test_a_phrase_of_a_crowd_of_long_lines_makes_no_pairs(spark, monkeypatch):
    """A phrase too rare for the sketch, in lines too long for parities to tell apart, comes last in the order of exact counts."""
    from docloom.llm import line_dedup

    found, own = [], line_dedup._possible

    def spy(pairs, percent):
        out = own(pairs, percent)
        found.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "_possible", spy)
    monkeypatch.setattr(line_dedup, "_classes", lambda lines, width: ",".join(["0"] * line_dedup.BUCKETS))
    phrase = " ".join(f"p{i}" for i in range(150))
    lines = [f"{phrase} " + " ".join(f"w{i}x{j}" for j in range(150)) for i in range(48)]
    lines += [f"{lines[7]} end", f"start {lines[9]}", f"{phrase} one more", f"{phrase} and other ends"]
    rows = list(enumerate(lines))
    got = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == brute_lines(rows) and got[48] == got[49] == got[51] == "" and got[7] and got[9] and got[50]
    assert sum(found) <= 200  # each line once with the earliest, but not 48 * 47 / 2 pairs
