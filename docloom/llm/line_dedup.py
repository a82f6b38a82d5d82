"""Near-duplicate lines by an exact set-similarity join.

A line's tokens are its distinct shingles of five words (all words as one, if fewer), as 56-bit
hashes led by a rarity class, so that sorting a line's tokens puts rare ones first in one order for
all lines. Two lines of n and m tokens with Jaccard index t share at least o = t / (1 + t) * (n + m)
tokens, hence a token among the first n - o + 1 of one and the first m - o + 1 of the other (prefix
filter), whose places leave room for o common tokens (positional filter), their sizes differ
little (length filter), and the parities of their tokens in 64 classes differ in n + m - 2 * o classes
at most, as each token that one line has alone changes one (parity filter). Lines that share a phrase
alone fail the last, so that a phrase of many lines makes no pairs of them all. What remains is
verified on whole token sets. Sets of 3 tokens at most need
an equal set and meet by the set's hash. A line that matches an earlier one, by (document id, text
hash, place), goes.

Rarity. A sketch of frequent items runs over the shingles of all lines, one for each of SKETCHES
groups of tasks and then over these, in bounded memory. The FREQUENT commonest shingles mark the
131,072 buckets of hashes they fall into with the class of their count; tokens of other buckets are
of class 0 and first in the order. A rare token in a marked bucket comes late, and what the sketch
misses comes early: both cost time only, as any order gives the same lines.

Scale. Equal lines are one line from the first aggregation on. Lines that make up more than one in
2,000 of all (2,000 at most) enter the token exchange by their first occurrence only. Tokens of one
line alone go before any join; each line is compared with the earliest line of its tokens first,
and only lines that this does not remove meet the rest. They meet by tokens that CROWD lines at most
have in their prefixes. Two lines that share a token of more lines are both among the lines that have
such a token, so that these meet once more among themselves, by prefixes in the order of the exact
numbers of them that have a token: a phrase of many lines, of which the sketch knows nothing, is last
in that order, and lines that share the phrase alone do not meet.

Main path: DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.scratch import Scratch

WIDTH = 5
BUCKETS = 1 << 17
#: Frequent shingles that order tokens, items that a sketch tracks, sketches that are merged in the end.
FREQUENT, TRACKED, SKETCHES = 1 << 14, 1 << 16, 64
#: A line is hot if it is more than one in so many of all lines.
HOT_PART = 2000
#: Lines that share a token of more lines than so many meet in an order of their own.
CROWD = 32
_SPACE = " \t\n\x0b\x0c\r"
_ORDER = ["doc_id", "h", "pos"]
_PAIR = ["x_k1", "x_k2", "y_k1", "y_k2"]


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once a row: the optimizer would copy a plain projection
    into every use of it, even for each element inside a lambda function."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _words(line: Column) -> Column:
    return F.split(F.lower(F.btrim(line, F.lit(_SPACE))), "[ \\t-\\r]+")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, h, pos, w, k1, k2: every line with a word, its lower-cased words and two hashes of them."""
    body = docs.select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.btrim("line", F.lit(_SPACE)) != "")
    rows = _once(body, "w", _words(F.col("line")))
    return rows.select("doc_id", "h", "pos", "w", F.xxhash64("w").alias("k1"), F.hash("w").alias("k2"))


def _classes(lines: DataFrame, width: int) -> str:
    """The rarity class of each bucket of hashes, as a list with commas."""
    # the places are exploded, not the hashes, so that hashing runs in generated code
    placed = lines.where(F.size("w") >= width).select("w", F.explode(F.sequence(F.lit(0), F.size("w") - width)).alias("i"))
    shingles = placed.select(F.xxhash64(*(F.get(F.col("w"), F.col("i") + k) for k in range(width))).alias("t"))
    # grouped by a constant in the end, as the function fails on no rows at all
    some = shingles.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("g")).agg(F.expr(f"approx_top_k_accumulate(t, {TRACKED})").alias("s"))
    top = some.groupBy(F.lit(1).alias("g")).agg(F.expr(f"approx_top_k_combine(s, {TRACKED})").alias("s")).select(F.inline(F.expr(f"approx_top_k_estimate(s, {FREQUENT})")))
    found = [0] * BUCKETS
    for item, count in top.where("count > 1").collect():  # FREQUENT rows at most
        found[item & (BUCKETS - 1)] = max(found[item & (BUCKETS - 1)], _class(count))
    return ",".join(map(str, found))


def _class(count: int) -> int:
    return min(126, int(4 * math.log2(count)))


def _exact_classes(sets: DataFrame) -> str:
    """As _classes, from the number of sets that have a token."""
    counts = sets.select(F.explode("tok").alias("t")).groupBy("t").count().where("count > 1")
    found = [0] * BUCKETS
    for bucket, count in counts.groupBy(F.col("t").bitwiseAND(BUCKETS - 1)).agg(F.max("count")).collect():  # BUCKETS rows at most
        found[bucket] = _class(count)
    return ",".join(map(str, found))


def _hashes(width: int) -> Column:
    each = F.transform(F.sequence(F.lit(0), F.size("w") - width), lambda i: F.xxhash64(*(F.get(F.col("w"), i + k) for k in range(width))))
    return F.when(F.size("w") >= width, each).otherwise(F.array(F.xxhash64("w")))


def _token(h: Column, classes: str) -> Column:
    table = F.split(F.lit(classes), ",").cast("array<bigint>")
    return F.shiftleft(F.get(table, h.bitwiseAND(BUCKETS - 1).cast("int")), 56).bitwiseOR(h.bitwiseAND((1 << 56) - 1))


def _tokens(rows: DataFrame, classes: str, width: int) -> DataFrame:
    """rows with tok: the line's distinct tokens, rare first."""
    return _once(rows, "tok", F.sort_array(F.array_distinct(F.transform(_hashes(width), lambda h: _token(h, classes)))))


def _share(percent: int, n: Column) -> Column:
    """The least part of n tokens that a partner can share."""
    return F.floor((n * percent + 99) / 100).cast("int")


def _overlap(percent: int, n: Column, m: Column) -> Column:
    return F.floor(((n + m) * percent + 99 + percent) / (100 + percent)).cast("int")


def removed_lines(docs: DataFrame, scratch: Scratch, percent: int = 80, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(first, gone) for docs of doc_id, h (the text's hash) and text, no nulls in the last: the first
    occurrence of each distinct line, as k1, k2, doc_id, h, pos, and the k1, k2 of lines of which an
    earlier different line is a match."""
    lines = _lines(docs)
    order = F.struct(*_ORDER)
    seen = lines.groupBy("k1", "k2").agg(F.min(order).alias("o"), F.count("*").alias("c"))
    first = scratch.keep(seen.select("k1", "k2", *(F.col(f"o.{x}").alias(x) for x in _ORDER), "c"), "first")
    scratch.free()
    classes = _classes(lines, width)
    total = first.agg(F.sum("c")).first()[0] or 0
    # at most HOT_PART rows
    hot = first.where(F.col("c") * HOT_PART > total).select("k1", "k2", order.alias("only"))
    once = lines.join(F.broadcast(hot), ["k1", "k2"], "left").where(F.col("only").isNull() | (F.col("only") == order))
    once = _tokens(once.where(F.size("w") >= width), classes, width).withColumn("n", F.size("tok"))
    # fewer tokens can be matched by an equal set only, whose hash is then the one token; for sizes of 4 and more sets may differ
    least = math.ceil(percent / (100 - percent)) if percent < 100 else 1
    few = F.col("n") < min(least, 4)
    # unequal lines have an equal set of 3 tokens at most only if their shingles go round in a circle, so that words come again
    once = once.where(~few | (F.size(F.array_distinct("w")) < F.size("w")))
    prefix = F.when(few, F.array(F.xxhash64("tok"))).otherwise(F.slice("tok", F.lit(1), F.col("n") - _share(percent, F.col("n")) + 1))
    # one exchange, by token; a token of one line alone goes there
    prefix = once.select("k1", "k2", "n", F.posexplode(prefix).alias("at", "t"))
    of = Window.partitionBy("t")
    spread = prefix.select("*", *(f(c).over(of).alias(f"{name}_{c}") for c in ("k1", "k2") for name, f in (("lo", F.min), ("hi", F.max))))
    rows = spread.where("lo_k1 <> hi_k1 OR lo_k2 <> hi_k2").select("t", "k1", "k2", "n", "at").distinct()
    rows = scratch.keep(rows.join(first.select("k1", "k2", order.alias("o")), ["k1", "k2"]), "met0")
    scratch.free()
    equal, rows = rows.where(few), rows.where(~few)
    earliest = equal.groupBy("t", "n").agg(F.min("o").alias("o_"))
    repeats = equal.join(earliest, ["t", "n"]).where(F.col("o") > F.col("o_")).select("k1", "k2")

    # dealt once by the keys that all joins below have; each of them would exchange the sets again
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = scratch.keep_bucketed(_tokens(_texts(docs, rows, buckets), classes, width).select("k1", "k2", "tok"), "sets", buckets, ["k1", "k2"], [])
    scratch.free()
    # parities join here, so that the exchange of all prefixes does without them
    rows = rows.join(sets.select("k1", "k2", _parities(F.col("tok")).alias("par")), ["k1", "k2"]).withColumn("c", F.count("*").over(of))
    rows = scratch.keep_bucketed(rows, "shared", buckets, ["t"], [])
    scratch.free()
    leader = rows.groupBy("t").agg(F.min(F.struct("o", "k1", "k2", "n", "par", "at")).alias("y"))
    met = _possible(rows.alias("x").join(leader.select("t", "y.*").alias("y"), "t"), percent)
    # of the earliest lines of its tokens a line is held against the one of most tokens
    best = F.row_number().over(Window.partitionBy("x_k1", "x_k2").orderBy(F.desc("shared"), "y_k1", "y_k2"))
    met = scratch.keep(met.withColumn("r_", best).where("r_ = 1").select(*_PAIR), "met1")
    gone = scratch.keep(_verified(met, sets, percent), "gone1")
    scratch.free()
    few_lines, crowds = rows.where(F.col("c") <= CROWD), rows.where(F.col("c") > CROWD)
    more = _meet(few_lines, gone, percent)
    if not crowds.isEmpty():
        crowded = crowds.select("k1", "k2", "n", "o", "par").distinct().join(sets, ["k1", "k2"])
        exact = _exact_classes(crowded)
        crowded = _once(crowded, "again", F.sort_array(F.transform("tok", lambda h: _token(h, exact))))
        prefix = F.slice("again", F.lit(1), F.col("n") - _share(percent, F.col("n")) + 1)
        again = scratch.keep(crowded.select("k1", "k2", "n", "o", "par", F.posexplode(prefix).alias("at", "t")), "again")
        # a pair that shares a token of a crowd has both lines in here; its count of shared tokens above is short
        more = more.union(_meet(again, gone, percent)).distinct()
    more = scratch.keep(more.join(met, _PAIR, "left_anti").select(*_PAIR), "met2")
    scratch.free()
    gone = gone.union(scratch.keep(_verified(more, sets, percent), "gone2")).union(repeats)
    scratch.drop("met1", "met2", "sets", "shared", "again")
    scratch.free()
    return first, gone


def _parities(tok: Column) -> Column:
    """64 bits, each whether the number of tokens of its class is odd."""
    one = F.lit(1).cast("long")
    return F.aggregate(tok, F.lit(0).cast("long"), lambda s, t: s.bitwiseXOR(F.call_function("shiftleft", one, t.bitwiseAND(63).cast("int"))))


def _texts(docs: DataFrame, rows: DataFrame, parts: int) -> DataFrame:
    """k1, k2, w: the words of the lines that share a token, each taken from its first occurrence; dealt by k1 and k2."""
    places = rows.select("k1", "k2", "o").distinct()
    places = places.groupBy(F.col("o.doc_id").alias("id_"), F.col("o.h").alias("h_")).agg(F.collect_list(F.struct(F.col("o.pos").alias("pos"), "k1", "k2")).alias("at_"))
    held = docs.join(places, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")))
    held = held.select("at_", F.explode(F.array(F.split("text", "\n"))).alias("parts")).select("parts", F.inline("at_"))
    # rows that repeat a document give its lines again
    held = held.select("k1", "k2", F.get("parts", F.col("pos")).alias("line")).repartition(parts, "k1", "k2").groupBy("k1", "k2").agg(F.first("line").alias("line"))
    return _once(held, "w", _words(F.col("line"))).select("k1", "k2", "w")


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs of a line x and an earlier line y that pass the length and parity filters, with shared: how many tokens
    of pairs they have that pass the positional filter, as all common tokens of lines that match do;
    one of them passes the prefix filter too. need: how many tokens two whole prefixes must share if the
    lines match, as beyond them one set has too few left."""
    n, m, i, j = F.col("x.n"), F.col("y.n"), F.col("x.at"), F.col("y.at")
    most = _overlap(percent, n, m)
    room = F.least(i, j) + 1 + F.least(n - i, m - j) - 1
    apart = F.bit_count(F.col("x.par").bitwiseXOR(F.col("y.par")))
    rows = pairs.where((F.col("y.o") < F.col("x.o")) & (n >= _share(percent, m)) & (m >= _share(percent, n)) & (room >= most) & (apart <= n + m - 2 * most))
    need = most + 1 - F.greatest(_share(percent, n), _share(percent, m))
    rows = rows.select(*(F.col(f"{s}.{k}").alias(f"{s}_{k}") for s in "xy" for k in ("k1", "k2")), ((i <= n - most) & (j <= m - most)).alias("fits"), need.alias("need"))
    return rows.groupBy(*_PAIR).agg(F.count("*").alias("shared"), F.max("fits").alias("fits"), F.min("need").alias("need")).where("fits")


def _meet(rows: DataFrame, gone: DataFrame, percent: int) -> DataFrame:
    """Pairs of a line of rows that has not gone and any earlier one that can match, by their tokens."""
    left = rows.join(gone, ["k1", "k2"], "left_anti")
    return _possible(left.alias("x").join(rows.alias("y"), "t"), percent).where("shared >= need").select(*_PAIR)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """k1, k2 of the x of pairs that match their y."""
    for s in "xy":
        pairs = pairs.join(sets.select(F.col("k1").alias(f"{s}_k1"), F.col("k2").alias(f"{s}_k2"), F.col("tok").alias(s)), [f"{s}_k1", f"{s}_k2"])
    same = F.size(F.array_intersect("x", "y"))
    ok = 100 * same >= percent * (F.size("x") + F.size("y") - same)
    return pairs.where(ok).select(F.col("x_k1").alias("k1"), F.col("x_k2").alias("k2")).distinct()


def dedup_lines(docs: DataFrame, percent: int = 80, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", report: bool = False, drop_copies: bool = False) -> DataFrame:
    """docs without the lines of which an earlier line of the table is a match.

    A line matches an earlier one if percent of the union of their tokens is common to both; words
    are runs of characters other than ASCII white space, in lower case. Earlier means a smaller id,
    null first, then a smaller text hash, then a smaller place; rows that agree in id and text are
    one document and lose the same lines. Lines without words stay. A null text stays null. A text
    that loses all its lines is empty; its row stays, unless drop_copies takes out rows that had
    lines with words and keep none. report adds n_lines and n_removed (long), in place of columns of
    these names. Other columns are carried, whatever their names; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    # the columns to carry are one column, so that no name clashes
    carried = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row")
    base = docs.select(carried, F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    first, gone = removed_lines(base.where("text IS NOT NULL").select("doc_id", "h", "text"), scratch, percent, width)
    stay = first.join(gone, ["k1", "k2"], "left_anti")
    places = stay.groupBy(F.col("doc_id").alias("id_"), F.col("h").alias("h_")).agg(F.collect_list("pos").alias("stay"))
    joined = base.join(places, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left")
    parts = F.split("text", "\n")
    stays = F.coalesce("stay", F.array().cast("array<int>"))
    kept = F.filter(parts, lambda line, i: F.array_contains(stays, i) | (F.btrim(line, F.lit(_SPACE)) == ""))
    joined = joined.select("row", "stay", F.size(parts).alias("n"), F.explode(F.array(kept)).alias("kept"))
    if drop_copies:
        joined = joined.where(F.col("stay").isNotNull() | F.col("kept").isNull() | (F.col("n") == F.size("kept")))
    cut = F.array_join("kept", "\n").alias(text)
    out = [cut if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if not report or c not in ("n_lines", "n_removed")]
    if report:
        out += [F.when(F.col("kept").isNull(), 0).otherwise(F.col("n")).cast("long").alias("n_lines"), F.when(F.col("kept").isNull(), 0).otherwise(F.col("n") - F.size("kept")).cast("long").alias("n_removed")]
    return joined.select(*out)
