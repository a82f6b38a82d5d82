"""Deduplication, manifests and set operations on corpus tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import shingles
from docloom.scratch import Scratch


#: Places of a stretch that one task solves in order, and stretches of a group of them.
STRETCH, STRETCHES = 2048, 4096


def first_of_each(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """The first row of each key. A limit in each task goes before the exchange, so hot keys are thin."""
    whole = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), key.alias("key"), order.alias("order"))
    return whole.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("order"))).where("n = 1").select("row.*")


def near_pairs(rows: DataFrame, doc_id: str = "doc_id", text: str = "text", lookback: int = 50, percent: int = 85) -> DataFrame:
    """a, b, jaccard: rows at most lookback places apart by id whose 5-word shingles agree.

    Rows are numbered without a global sort (see numbered). A null text has no pair. Only prefixes of the
    shingles in the order of their hashes meet (see _candidates); the pairs that they leave are decided
    on whole sets, which are made for rows of such pairs alone.
    """
    scratch = Scratch(rows.sparkSession, "near")
    own = rows.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    head = lambda s: F.struct(F.size(s).alias("n"), F.slice(s, F.lit(1), F.size(s) - _share(percent, F.size(s)) + 1).alias("x"))
    made = lambda r: r.select("id", F.xxhash64("text").alias("h"), F.explode(F.array(F.when(F.col("text").isNotNull(), _hashes()))).alias("s"), *_AT).select("id", "h", head(F.col("s")).alias("head"), *_AT)
    placed = numbered(own, "id", scratch, then=made)
    met = scratch.keep(_candidates(placed.where("head.n > 0").select("place", "head.*"), lookback, percent), "met")
    # a repeated id with the same text has the same set
    named = placed.select("place", "id", "h")
    for k in "ab":
        met = met.join(named.select(F.col("place").alias(f"p{k}"), F.col("id").alias(k), F.col("h").alias(f"h{k}")), f"p{k}")
    met = scratch.keep(met, "pairs")
    needed = met.select(F.col("a").alias("id"), F.col("ha").alias("h")).union(met.select("b", "hb")).distinct()
    texts = own.where("text IS NOT NULL").withColumn("h", F.xxhash64("text")).join(needed, ["id", "h"], "left_semi")
    sets = scratch.keep(texts.groupBy("id", "h").agg(F.first("text").alias("text")).select("id", "h", _hashes().alias("s")), "sets")
    for k in "ab":
        met = met.join(sets.select(F.col("id").alias(k), F.col("h").alias(f"h{k}"), F.col("s").alias(f"s{k}")), [k, f"h{k}"])
    both = met.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("c"), (F.size("sa") + F.size("sb")).alias("n"))
    union = F.col("n") - F.col("c")
    return both.where(100 * F.col("c") >= percent * union).select("a", "b", F.round(F.col("c") / union, 6).alias("jaccard"))


def _hashes() -> Column:
    """The hashes of text's distinct shingles, in their order."""
    return F.sort_array(F.array_distinct(F.transform(shingles("text"), lambda s: F.xxhash64(s))))


def _share(percent: int, n: Column) -> Column:
    """The least part of a set of n that one alike shares."""
    return F.floor((n * percent + 99) / 100).cast("int")


def _candidates(heads: DataFrame, lookback: int, percent: int) -> DataFrame:
    """pa, pb: rows (place, n, x) of which the first can be alike, by the first elements of their sorted sets.

    Sets of n and m alike share at least o = percent * (n + m) / (100 + percent) elements, hence one
    among the first n - o + 1 of one and the first m - o + 1 of the other. Of the heads, the one that ends
    first has met all that it shares with the other set, so that the heads share o less the rest of it.
    An element meets only rows of the same or the next stretch of lookback places, so that common ones
    stay local.
    """
    rows = heads.select("place", "n", F.floor(F.col("place") / lookback).alias("stretch"), F.posexplode("x").alias("at", "x"))
    a = rows.select(F.col("place").alias("pa"), F.col("n").alias("na"), F.col("at").alias("ia"), "x", "stretch")
    b = rows.withColumn("stretch", F.explode(F.array(F.col("stretch"), F.col("stretch") - 1))).select(F.col("place").alias("pb"), F.col("n").alias("nb"), F.col("at").alias("ib"), "x", "stretch")
    na, nb = F.col("na"), F.col("nb")
    least = F.floor(((na + nb) * percent + 99 + percent) / (100 + percent)).cast("int")
    near = (F.col("pb") > F.col("pa")) & (F.col("pb") - F.col("pa") <= lookback) & (na >= _share(percent, nb)) & (nb >= _share(percent, na))
    met = a.join(b, ["x", "stretch"]).where(near).withColumn("fits", (F.col("ia") <= na - least) & (F.col("ib") <= nb - least))
    both = met.groupBy("pa", "pb", "na", "nb").agg(F.count("*").alias("c"), F.max("fits").alias("fits"))
    return both.where(F.col("fits") & (F.col("c") > least - F.greatest(_share(percent, na), _share(percent, nb)))).select("pa", "pb")


#: The number of a row's range and its place in it.
_AT = ["p_", "i_"]


def _ranged(rows: DataFrame, order: str) -> DataFrame:
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order)
    return ranged.withColumn("p_", F.spark_partition_id()).withColumn("i_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))


def numbered(rows: DataFrame, order: str, scratch: Scratch, name: str = "place", then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """rows with their place (from 0) by order: counted by range, then within it, never in one task.

    The ranges are drawn once: the rows are written with the number of their range and their place
    in it, and counts and places both come from the written table. then makes what is written of the rows in
    their ranges and keeps the columns p_ and i_.
    """
    ranged = scratch.keep(then(_ranged(rows, order)), "ranged")
    counts = ranged.groupBy("p_").agg(F.count("*").alias("c_"))
    before = F.coalesce(F.sum("c_").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each task
    return ranged.join(F.broadcast(counts.select("p_", before.alias("b_"))), "p_").withColumn(name, F.col("b_") + F.col("i_")).drop("p_", "i_", "b_")


def near_survivors(rows: DataFrame, doc_id: str = "doc_id", text: str = "text", lookback: int = 50, percent: int = 85, same: Column | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """id, kept and carried: a row goes if one of the last lookback rows that are kept before it is a near
    duplicate. A null text is kept and counts among those. carried columns lie with the sets, so that they move
    once. same is an expression of carried columns; of rows in which it agrees, all but the first by id are left out
    beforehand.

    The rule is sequential. Rows are dealt into stretches of neighbouring places, and a stretch needs of
    all before it only the last lookback kept rows. It is first solved as if there were none; then each
    gets those that the verdicts so far leave before it, over all stretches, and is solved again if they
    are others than it was solved with. A round settles at least the first unsettled stretch, so that
    the verdicts without change are the rule's; a run of copies over many stretches, of which each has
    kept its first, is settled at once. A round costs a row at most a lookup of its shingles among
    those of lookback rows, and no pairs are formed.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "survivors")
    hashed = F.when(F.col("text").isNotNull(), F.transform(shingles("text"), lambda s: F.xxhash64(s)))
    ranged = _ranged(rows.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *(c for c in carried if c != "text")), "id")
    # a stretch lies in one range, so that its number needs no count of the rows before; the sets are dealt by it once
    place = F.shiftleft(F.col("p_").cast("long"), 33) + F.col("i_")
    placed = ranged.select("id", place.alias("place"), _stretch(place).alias("stretch"), F.coalesce(hashed, F.array().cast("array<long>")).alias("s"), *carried)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.keep_bucketed(placed, "sets", buckets, "stretch", [])
    if same is not None:
        scratch.free()
        first = placed.select(same.alias("same"), "place").groupBy("same").agg(F.min("place").alias("place"))
        first = first.groupBy(_stretch(F.col("place")).alias("stretch")).agg(F.collect_list("place").alias("first"))
        first = scratch.keep_bucketed(first, "first", buckets, "stretch", [])
        placed = placed.join(first, "stretch").where(F.array_contains("first", F.col("place"))).drop("first")
    none = F.array().cast("array<long>")
    before = scratch.keep(placed.select("stretch").distinct().withColumn("before", none), "before0")
    solved = scratch.keep(_solved(placed, before, lookback, percent), "solved0")
    turn = 0
    while True:
        turn += 1
        now = scratch.keep(_kept_before(solved, lookback), f"before{turn}")
        other = now.join(before.withColumnRenamed("before", "was"), "stretch").where(F.col("before") != F.col("was")).select("stretch", "before")
        if not other.limit(1).count():
            break
        again = _solved(placed, other, lookback, percent)
        solved = scratch.keep(solved.join(other.select("stretch"), "stretch", "left_anti").unionByName(again), f"solved{turn}")
        scratch.drop(f"solved{turn - 1}", f"before{turn - 1}")
        before = now
    ids = placed.select("id", "place", "stretch", *carried).join(solved.select("stretch", "gone"), "stretch")
    return ids.select("id", (~F.array_contains("gone", F.col("place"))).alias("kept"), *carried)


def _stretch(place: Column) -> Column:
    """The stretch of a place, which has the number of its range in the bits from the 34th on."""
    return F.shiftleft(F.shiftright(place, 33), 32) + F.floor(place.bitwiseAND((1 << 33) - 1) / STRETCH)


def _solved(placed: DataFrame, before: DataFrame, lookback: int, percent: int) -> DataFrame:
    """stretch, gone (places) and tail (the last kept places of its own) of the stretches of before, with
    the places kept before them. The sets are read where they lie; only those kept before a stretch move."""
    asked = before.select("stretch", F.explode("before").alias("place"))
    owners = asked.select("place").distinct().groupBy(_stretch(F.col("place")).alias("stretch")).agg(F.collect_list("place").alias("places"))
    kept = placed.join(owners, "stretch").where(F.array_contains("places", F.col("place"))).select(F.col("place").alias("at"), F.col("s").alias("kept"))
    held = asked.join(kept, F.col("place") == F.col("at")).select("stretch", "place", F.col("kept").alias("s"))
    rows = placed.join(before.select("stretch"), "stretch", "left_semi").select("stretch", "place", "s")

    def solve(own: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        part = pd.concat([kept.assign(held=True), own.assign(held=False)]).sort_values("place")
        sizes: dict[int, int] = {}  # of the last kept rows, oldest first
        has: dict[int, set] = {}  # a shingle to the kept rows that have it
        sets: dict[int, list] = {}
        gone, tail = [], []
        for place, s, inherited in zip(part["place"], part["s"], part["held"], strict=True):
            s = s.tolist()
            if not inherited:
                shared: dict[int, int] = {}
                for x in s:
                    for k in has.get(x, ()):
                        shared[k] = shared.get(k, 0) + 1
                if any(100 * c >= percent * (sizes[k] + len(s) - c) for k, c in shared.items()):
                    gone.append(place)
                    continue
                tail.append(place)
            if len(sizes) == lookback:
                old = next(iter(sizes))
                del sizes[old]
                for x in sets.pop(old):
                    has[x].discard(old)
                    if not has[x]:
                        del has[x]
            sizes[place], sets[place] = len(s), s
            for x in s:
                has.setdefault(x, set()).add(place)
        return pd.DataFrame({"stretch": [part["stretch"].iloc[0]], "gone": [gone], "tail": [tail[-lookback:]]})

    return rows.groupBy("stretch").cogroup(held.groupBy("stretch")).applyInPandas(solve, "stretch long, gone array<long>, tail array<long>")


def _kept_before(solved: DataFrame, lookback: int) -> DataFrame:
    """stretch and before: the last kept places ahead of each stretch, folded within groups of stretches,
    over the groups (a row each), and within them again."""
    tails = solved.select("stretch", "tail", F.floor(F.col("stretch") / STRETCHES).alias("b"))

    def fold(part: pd.DataFrame, start: list, key: str) -> tuple[list, list]:
        out, last = [], list(start)
        for own in part.sort_values(key)["tail"]:
            out.append(last)
            last = [*last, *own][-lookback:]
        return out, last

    def group(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": [part["b"].iloc[0]], "tail": [fold(part, [], "stretch")[1]]})

    def over(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": part.sort_values("b")["b"], "start": fold(part, [], "b")[0]})

    def within(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("stretch")
        return pd.DataFrame({"stretch": part["stretch"], "before": fold(part, part["start"].iloc[0], "stretch")[0]})

    starts = tails.groupBy("b").applyInPandas(group, "b long, tail array<long>").withColumn("all", F.lit(True)).groupBy("all").applyInPandas(over, "b long, start array<long>")
    return tails.join(starts, "b").groupBy("b").applyInPandas(within, "stretch long, before array<long>")


def not_done(new: DataFrame, manifest: DataFrame, key: str = "url") -> DataFrame:
    """Rows of new whose key has no ok row in the manifest."""
    return new.join(manifest.where("status = 'ok'").select(key), key, "left_anti")


def with_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_semi")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def replaced(table: DataFrame, new: DataFrame, strategy: str) -> DataFrame:
    """table with the rows of one strategy replaced; the others stay."""
    return table.where(F.col("strategy") != strategy).unionByName(new)


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place where each first stands."""
    return rows.groupBy(value).agg(F.min(order).alias("first_seen"))


def upserted(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return table.join(new.select(key), key, "left_anti").unionByName(new)
