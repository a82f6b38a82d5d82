"""Citations: sentences of answers matched with passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import col, let, words

LEAST_OVERLAP, LEAST_WORDS, QUOTE_WORDS, LOOK_CHARS, QUOTE_CHARS = 0.3, 3, 50, 200, 300


def sentences(text: Column | str) -> Column:
    return F.split(col(text), r"(?<=[.!?])\s+")


def citations(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, sentence_no, claim, passage_rank, score, quote: each sentence with its best passage.

    answers: query_id and answer; passages: query_id, passage_rank and text, a bounded number for a
    query. The score is the common distinct words over the sentence's distinct words plus one; it
    has to exceed 0.3, the first of the best passages wins, sentences of under 3 words are passed over.
    """
    said = answers.select("query_id", F.posexplode(sentences("answer")).alias("sentence_no", "claim"))
    said = said.select("*", F.explode(F.array(words(F.lower("claim")))).alias("w")).where(F.size("w") >= LEAST_WORDS)
    own = F.array_distinct("w")
    texts = passages.select("query_id", "passage_rank", "text", F.array_distinct(words(F.lower("text"))).alias("t"))
    scored = said.join(texts, "query_id").withColumn("score", F.round(F.size(F.array_intersect(own, "t")) / (F.size(own) + 1), 6))
    order = Window.partitionBy("query_id", "sentence_no").orderBy(F.desc("score"), "passage_rank")
    best = scored.where(F.col("score") > LEAST_OVERLAP).withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.select("query_id", "sentence_no", "claim", "passage_rank", "score", quote("claim", "text").alias("quote"))


def quote(claim: Column | str, passage: Column | str) -> Column:
    """The claim's own words in the passage if they stand there; else at most 50 words from the first
    place after which, within 200 characters, most of the claim's first five long words stand; else
    the first 50 words. A null passage or claim gives null.

    The number of words after a place changes only where a word leaves or enters the 200 characters,
    so the first best place is the first one or one at which an occurrence just comes into sight.
    """
    p, c = col(passage), col(claim)
    low = F.lower(p)
    at = F.position(F.lower(c), low)
    keys = F.slice(F.filter(words(F.lower(c)), lambda w: F.char_length(w) > 3), 1, 5)
    # the pieces between occurrences of a word give their places in one pass over the passage
    cut = lambda text: F.array_join(F.slice(words(text), 1, QUOTE_WORDS), " ")

    def places(text: Column, w: Column) -> Column:
        """Where w stands; of occurrences that overlap one another only the first counts."""
        parts = F.split(text, F.concat(F.lit(r"\Q"), w, F.lit(r"\E")), -1)
        zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))
        walked = F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), zero, lambda s, x: F.struct((s["at"] + F.char_length(x) + F.char_length(w)).alias("at"), F.concat(s["out"], F.array(s["at"] + F.char_length(x))).alias("out")))
        return walked["out"]

    first = lambda at, w: F.greatest(at + F.char_length(w) - LOOK_CHARS, F.lit(1))
    spans = lambda text, ks: F.transform(ks, lambda w: F.transform(places(text, w), lambda at: F.struct(first(at, w).alias("from"), at.alias("to"))))
    counts = lambda all_: F.transform(F.array_sort(F.array_distinct(F.flatten(F.transform(all_, lambda one: F.transform(one, lambda x: x["from"]))))), lambda i: F.struct(F.size(F.filter(all_, lambda one: F.exists(one, lambda x: (x["from"] <= i) & (i <= x["to"])))).alias("n"), (-i).alias("back")))
    best = let(let(low, lambda text: spans(text, keys)), lambda all_: F.array_max(counts(all_)))
    near = let(best, lambda b: F.when(b.isNull() | (b["n"] == 0), cut(p)).otherwise(cut(F.substring(p, -b["back"], QUOTE_CHARS))))
    return F.when(at > 0, F.substring(p, at, F.char_length(c))).otherwise(near)


def valid_quote(quote_text: Column | str, passage: Column | str) -> Column:
    return (col(quote_text) != "") & F.contains(F.lower(col(passage)), F.lower(col(quote_text)))
