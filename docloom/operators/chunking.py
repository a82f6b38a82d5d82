"""Fixed and heading-aware chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import chunk_id, col, strip, words

CHUNK_WORDS, STEP_WORDS, LEAST_WORDS, MOST_WORDS = 300, 255, 22, 384
#: More than the windows of any section.
PLACES = 1 << 32


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column computed once; a projection would be copied into lambda bodies."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def word_windows(rows: DataFrame, text: str, size: int = CHUNK_WORDS, step: int = STEP_WORDS) -> DataFrame:
    """rows with chunk_index and chunk_text: windows of size words every step words; none for texts without words."""
    rows = once(rows, "w_", words(text)).where(F.size("w_") > 0)
    last = F.greatest(F.ceil((F.size("w_") - size) / F.lit(step)), F.lit(0)).cast("int")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return rows.withColumn("chunk_text", F.array_join(F.slice("w_", F.col("chunk_index") * step + 1, F.lit(size)), " ")).drop("w_")


def fixed_chunks(docs: DataFrame, url: Column, text: str = "text") -> DataFrame:
    """docs' columns but text, with chunk_index, chunk_text, chunk_id and strategy."""
    rows = word_windows(docs, text).withColumn("chunk_id", chunk_id(url, F.lit("fixed"), F.col("chunk_index")))
    return rows.withColumn("strategy", F.lit("fixed")).drop(text)


def heading_pieces(docs: DataFrame) -> DataFrame:
    """docs' columns but text, with pos, heading_path and piece: the lines from a heading up to the next one. A
    heading of level n replaces the path from its n-th place on; lines before any heading are "Untitled". A text
    is cut where it lies, and only heading lines are folded."""
    pattern = r"^(#{1,6})\s+(.*)"
    rows = once(docs, "lines_", F.split("text", "\n")).where(F.col("lines_").isNotNull())
    heads = F.filter(F.transform("lines_", lambda line, i: F.struct(i.alias("pos"), line.alias("line"))), lambda h: h["line"].rlike(pattern))
    heads = F.transform(heads, lambda h: F.struct(h["pos"].alias("pos"), F.length(F.regexp_extract(h["line"], pattern, 1)).alias("level"), strip(F.regexp_extract(h["line"], pattern, 2)).alias("title")))
    zero = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<pos:int,path:string>>").alias("out"))

    def step(s: Column, h: Column) -> Column:
        stack = F.concat(F.slice(s["stack"], F.lit(1), h["level"] - 1), F.array(h["title"]))
        return F.struct(stack.alias("stack"), F.concat(s["out"], F.array(F.struct(h["pos"].alias("pos"), F.array_join(stack, " > ").alias("path")))).alias("out"))

    rows = once(rows, "paths_", F.aggregate(heads, zero, step)["out"])
    lead = F.array(F.struct(F.lit(0).alias("pos"), F.lit("Untitled").alias("path")))
    rows = once(rows, "starts_", F.when(F.get(F.col("paths_"), F.lit(0))["pos"] == 0, F.col("paths_")).otherwise(F.concat(lead, "paths_")))
    end = lambda i: F.coalesce(F.get(F.col("starts_"), i + 1)["pos"], F.size("lines_"))
    pieces = F.transform("starts_", lambda p, i: F.struct(p["pos"].alias("pos"), p["path"].alias("heading_path"), F.array_join(F.slice("lines_", p["pos"] + 1, end(i) - p["pos"]), "\n").alias("piece")))
    return rows.select(*(c for c in docs.columns if c != "text"), F.inline(pieces))


def sections(pieces: DataFrame) -> DataFrame:
    """doc_id, section, heading_path, section_text, more: a path's lines together, in order of first sight."""
    by_path = pieces.groupBy("doc_id", "heading_path").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("ls"), F.first("more").alias("more"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1
    return by_path.select("doc_id", number.alias("section"), "heading_path", strip(F.array_join(F.transform("ls", lambda x: x["piece"]), "\n")).alias("section_text"), "more")


def merged_sections(found: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Sections of fewer than least words join the one before; its number and path stay. Empty ones go."""
    rows = found.where("section_text <> ''").withColumn("n", F.size(words("section_text")))
    order = Window.partitionBy("doc_id").orderBy("section")
    starts = F.when((F.row_number().over(order) == 1) | (F.col("n") >= least), 1).otherwise(0)
    rows = rows.withColumn("s_", starts).withColumn("group_", F.sum("s_").over(order))
    merged = rows.groupBy("doc_id", "group_").agg(F.min(F.struct("section", "heading_path")).alias("h"), F.array_sort(F.collect_list(F.struct("section", "section_text"))).alias("t"), F.first("more").alias("more"))
    return merged.select("doc_id", "h.section", "h.heading_path", F.array_join(F.transform("t", lambda x: x["section_text"]), "\n").alias("section_text"), "more")


def structure_chunks(docs: DataFrame, url: str, doc_id: str = "doc_id", text: str = "text", most: int = MOST_WORDS, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, chunk_id, heading_path, chunk_text, place, strategy and docs' columns to carry: one chunk a merged section;
    sections of over most words in windows, whose ids have the suffix __sub and a number. place orders a document's
    chunks. Ids are distinct; rows without one have no chunks. Texts move once, as pieces dealt by document."""
    more = F.struct(col(url).alias("u_"), *carried)
    base = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), more.alias("more"))
    merged = once(merged_sections(sections(heading_pieces(base).repartition("doc_id"))), "w_", words("section_text"))
    long = F.size("w_") > most
    last = F.when(long, F.ceil((F.size("w_") - CHUNK_WORDS) / F.lit(STEP_WORDS))).otherwise(0).cast("int")
    rows = merged.select("*", long.alias("long_"), F.explode(F.sequence(F.lit(0), last)).alias("i_"))
    window = F.array_join(F.slice("w_", F.col("i_") * STEP_WORDS + 1, F.lit(CHUNK_WORDS)), " ")
    name = F.concat(chunk_id("more.u_", "heading_path", "section"), F.when(F.col("long_"), F.concat(F.lit("__sub"), F.col("i_").cast("string"))).otherwise(""))
    return rows.select(
        "doc_id", name.alias("chunk_id"), "heading_path", F.when(F.col("long_"), window).otherwise(F.col("section_text")).alias("chunk_text"),
        (F.col("section").cast("long") * PLACES + F.col("i_")).alias("place"), F.lit("structure_aware").alias("strategy"), *(F.col(f"more.{c}") for c in carried),
    )
