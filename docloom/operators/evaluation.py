"""Retrieval metrics and the golden set's checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import words

# fixed values: what a golden set holds
CATEGORY_COUNTS = {"single_hop_factual": 15, "multi_hop": 6, "comparative": 4, "temporal": 4, "unanswerable": 8, "ambiguous_adversarial": 3}
SPLIT_COUNTS = {"dev": 24, "test": 16}
QUOTE_WORDS = 25


def evaluable(items: DataFrame) -> DataFrame:
    """Items not marked unanswerable that have a relevance label."""
    labelled = (F.size(F.coalesce("relevant_ids", F.array().cast("array<bigint>"))) > 0) | F.col("expected_category").isNotNull()
    return items.where(~F.col("answerable").eqNullSafe(F.lit(False)) & labelled)


def relevant(hits: DataFrame, items: DataFrame) -> DataFrame:
    """hits with is_relevant: by the item's ids if it has any, else by its category."""
    rows = hits.join(items.select("query_id", "relevant_ids", "expected_category"), "query_id")
    ids = F.coalesce("relevant_ids", F.array().cast("array<bigint>"))
    return rows.withColumn("is_relevant", F.when(F.size(ids) > 0, F.array_contains(ids, F.col("id"))).otherwise(F.coalesce(F.col("category") == F.col("expected_category"), F.lit(False))))


def metrics(judged: DataFrame, cuts: tuple[int, ...] = (5, 20)) -> DataFrame:
    """query_id, recall_at_k for each k, reciprocal_rank."""
    recall = [F.max(F.when(F.col("is_relevant") & (F.col("rank") <= k), 1).otherwise(0)).alias(f"recall_at_{k}") for k in cuts]
    first = F.min(F.when(F.col("is_relevant"), F.col("rank")))
    return judged.groupBy("query_id").agg(*recall, F.round(F.coalesce(1 / first, F.lit(0.0)), 6).alias("reciprocal_rank"))


def means(per_query: DataFrame, by: list[str]) -> DataFrame:
    numbers = [c for c in per_query.columns if c not in [*by, "query_id"]]
    return per_query.groupBy(*by).agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 6).alias(c) for c in numbers))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def count_check(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, expected, n, ok for every expected value."""
    return expected.join(found, key, "left").select(key, "expected", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) == F.col("expected")).alias("ok"))


def item_problems() -> Column:
    """The messages of an item's broken rules, in order, as an array."""
    c, urls, quotes = F.col("category"), F.size("source_urls"), F.size("evidence_quotes")
    answerable = ~c.isin("unanswerable", "ambiguous_adversarial")
    checks = [
        (~F.col("split").isin(*SPLIT_COUNTS), "invalid split"),
        (~c.isin(*CATEGORY_COUNTS), "invalid category"),
        (F.exists("evidence_quotes", lambda q: F.size(words(q)) > QUOTE_WORDS), "quote too long"),
        ((c == "unanswerable") & (urls > 0), "unanswerable with sources"),
        ((c == "unanswerable") & (quotes > 0), "unanswerable with quotes"),
        ((c == "unanswerable") & (F.size("searched_terms") == 0), "unanswerable without searched terms"),
        (answerable & (urls == 0), "answerable without sources"),
        (answerable & (quotes == 0), "answerable without quotes"),
        ((c == "multi_hop") & (urls < 2), "multi-hop with under two sources"),
        ((c == "multi_hop") & (quotes < 2), "multi-hop with under two quotes"),
    ]
    return F.array_compact(F.array(*(F.when(test, F.lit(message)) for test, message in checks)))


# fixed values: the fields of a golden item, by name, and their types
FIELDS = {
    "id": "string", "query": "string", "category": "string", "expected_category": "string", "gold_answer": "string", "source_urls": "array<string>", "evidence_quotes": "array<string>",
    "searched_terms": "array<string>", "split": "string", "human_verified": "boolean",
}


def field_problems(item: Column, fields: dict[str, str] = FIELDS) -> Column:
    """Messages about the fields of an item that is a JSON object as text: those that are missing (then
    nothing else), lists and flags of another type, quotes that are no text."""
    keys = F.coalesce(F.json_object_keys(item), F.array().cast("array<string>"))
    names = F.array(*map(F.lit, sorted(fields)))
    missing = F.array_except(names, keys)
    value = lambda name: F.get_json_object(item, f"$.{name}")
    lists = [(~F.coalesce(F.startswith(F.ltrim(value(n)), F.lit("[")), F.lit(False)), f"{n} must be a list") for n, t in sorted(fields.items()) if t.startswith("array")]
    flags = [(~F.coalesce(value(n).isin("true", "false"), F.lit(False)), f"{n} must be true or false") for n, t in sorted(fields.items()) if t == "boolean"]
    found = F.array_compact(F.array(*(F.when(test, F.lit(message)) for test, message in [*flags, *lists])))
    return F.when(F.size(missing) > 0, F.array(F.concat(F.lit("missing fields: "), F.array_join(missing, ", ")))).otherwise(found)


def report(items: DataFrame, total: int = 40, categories: dict[str, int] | None = None, splits: dict[str, int] | None = None) -> DataFrame:
    """section, name, found, expected, ok for items (id, category, split, human_verified, problems as an
    array): the total, the counts by category and split, items with problems, ids that repeat, and
    items that nobody has verified."""
    spark = items.sparkSession
    count = lambda section, name, c, expected: items.agg(F.count_if(c).alias("found")).select(F.lit(section).alias("section"), F.lit(name).alias("name"), "found", F.lit(expected).cast("long").alias("expected"))
    parts = [count("total", "items", F.lit(True), total)]
    for section, column, table in (("category", "category", CATEGORY_COUNTS if categories is None else categories), ("split", "split", SPLIT_COUNTS if splits is None else splits)):
        expected = spark.createDataFrame([(k, v) for k, v in table.items()], "name string, expected long")
        found = items.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
        parts.append(count_check(found, expected, "name").select(F.lit(section).alias("section"), "name", F.col("n").alias("found"), "expected"))
    parts += [count("rules", "items with problems", F.size("problems") > 0, 0), duplicate_keys(items, "id").agg(F.count("*").alias("found")).select(F.lit("rules").alias("section"), F.lit("repeated ids").alias("name"), "found", F.lit(0).cast("long").alias("expected"))]
    parts.append(count("review", "not verified", ~F.coalesce("human_verified", F.lit(False)), 0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ok", F.col("found") == F.col("expected"))


def exit_code(found: DataFrame) -> int:
    """0: all holds; 2: only the review is open; 1: something else fails."""
    failed = {r["section"] for r in found.where("NOT ok").select("section").distinct().collect()}
    return 0 if not failed else 2 if failed == {"review"} else 1
