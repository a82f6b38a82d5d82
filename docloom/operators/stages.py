"""The corpus stages as one call each: cleaning, chunking, index rebuild, robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.functions import text as T
from docloom.functions.udfs import hashed_vector, html_markdown, nfkc
from docloom.operators import chunking, corpus
from docloom.scratch import Scratch
from docloom.sources import files
from docloom.sources.versions import Version, Versions

_META = ["brand", "category", "title", "has_table", "page_type"]
_CHUNK = ["chunk_id", "text", "strategy", "heading_path", "url", *_META]


EXTRACTED = "url string, doc_id string, source_url string, brand string, category string, title string, heading_path string, page_type string, has_table boolean, content_hash string, crawl_timestamp string, effective_date string, status string, owner string, error string, text string"
NORMALIZED = "url string, brand string, category string, title string, has_table boolean, page_type string, status string, text string"
CHUNKS = "chunk_id string, text string, strategy string, heading_path string, url string, brand string, category string, title string, has_table boolean, page_type string"


def extracted(raw: DataFrame, done: DataFrame | None = None, owners: DataFrame | None = None) -> DataFrame:
    """The rows that extraction adds to its manifest, with their text: of raw pages (url, brand,
    category, is_pdf, scraped_at, status, content) that are ok and have no ok row in done.

    ok rows have source_url and text; the others have url. A page whose text equals that of an earlier
    one, by scraped_at and address, or that of one of owners (content_hash, owner), is a duplicate and
    names its owner; one that cannot be read is failed, with an error, as are PDF files, which have no
    reader. Pages without an address are passed over, null pages have an empty text. Texts move once,
    by a number of their own: a text that a third of the pages share is no hot key.
    """
    scratch = Scratch(raw.sparkSession, "extract")
    rows = raw.where("status = 'ok' AND url IS NOT NULL").withColumn("is_pdf", F.coalesce("is_pdf", F.lit(False)))
    if done is not None:
        rows = corpus.not_done(rows, done.select(T.filled("url", "source_url").alias("url"), "status"))
    read = rows.withColumn("m", html_markdown(F.when(~F.col("is_pdf"), F.col("content")), F.col("url")))
    text = F.when(~F.col("is_pdf"), T.without_boilerplate("m.body"))
    error = F.when(F.col("is_pdf"), "no reader for PDF files").otherwise(F.col("m.error"))
    read = read.select("url", "brand", "category", "scraped_at", "is_pdf", F.col("m.title").alias("title"), text.alias("text"), error.alias("error"))
    pages = scratch.keep(read.withColumns({"content_hash": T.content_hash("text"), "n": F.monotonically_increasing_id()}), "pages")
    first = pages.where("text IS NOT NULL").groupBy("content_hash").agg(F.min(F.struct("scraped_at", "url", "n")).alias("first"))
    held = raw.sparkSession.createDataFrame([], "content_hash string, owner string") if owners is None else owners.groupBy("content_hash").agg(F.min("owner").alias("owner"))
    first = scratch.keep(first.join(held, "content_hash", "left"), "first")
    own = first.where("owner IS NULL").select(F.col("first.n").alias("n"))
    none = F.lit(None).cast("string")
    ok = pages.join(own, "n", "left_semi").select(
        none.alias("url"), T.url_hash("url").alias("doc_id"), F.col("url").alias("source_url"), "brand", "category", "title", T.heading_path("text").alias("heading_path"),
        R.support_type("url", F.lit(""), "text", F.col("is_pdf")).alias("page_type"), F.contains("text", F.lit("|---")).alias("has_table"), "content_hash", F.coalesce("scraped_at", F.lit("")).alias("crawl_timestamp"),
        none.alias("effective_date"), F.lit("ok").alias("status"), none.alias("owner"), none.alias("error"), "text",
    )
    again = pages.select("url", "content_hash", "n").join(first, "content_hash").where("owner IS NOT NULL OR n <> first.n")
    again = again.select("url", "content_hash", F.coalesce("owner", "first.url").alias("owner"), F.lit("duplicate").alias("status"))
    failed = pages.where("text IS NULL").select("url", F.lit("failed").alias("status"), F.coalesce("error", F.lit("")).alias("error"))
    columns = ok.columns
    return ok.unionByName(again, allowMissingColumns=True).unionByName(failed, allowMissingColumns=True).select(columns)


def run_extraction(store: Versions, raw: DataFrame, marks: dict[str, int] | None = None, hold_days: int | None = None) -> Version:
    """Extracts and cleans pages and commits the rows of both manifests at once.

    Pages that are done are passed over, and what an earlier run has extracted owns its text; with
    hold_days only for as long after it was scraped, so that what a run looks up is bounded.
    """
    base = store.current()
    done = store.read("extracted", EXTRACTED, base)
    owners = done.where("status = 'ok'").select("content_hash", F.col("source_url").alias("owner"), "crawl_timestamp")
    if hold_days is not None:
        oldest = raw.agg(F.min(F.try_to_timestamp("scraped_at"))).first()[0]
        if oldest is not None:
            owners = owners.where(F.try_to_timestamp("crawl_timestamp") >= F.lit(oldest) - F.make_dt_interval(F.lit(hold_days)))
    scratch = Scratch(raw.sparkSession, "run")
    rows = scratch.keep(extracted(raw, done, owners), "rows")
    made = store.change(append={"extracted": rows, "normalized": cleaned(rows, store.read("normalized", NORMALIZED, base))}, marks=marks, base=base)
    scratch.drop("rows")
    return made


def run_chunking(store: Versions, strategy: str | None = None) -> Version:
    """Chunks all cleaned pages anew, by both strategies or by one, and commits the table."""
    base = store.current()
    existing = store.read("chunks", CHUNKS, base) if "chunks" in base.tables else None
    made = chunked(store.read("normalized", NORMALIZED, base), existing, strategy)
    return store.change(replace={"chunks": made}, base=base)


def cleaned(records: DataFrame, done: DataFrame) -> DataFrame:
    """The rows that cleaning adds to its manifest, with their text: records (url, source_url, brand,
    category, title, has_table, page_type, status, text) that are ok and not done yet."""
    rows = records.withColumn("url", T.filled("url", "source_url")).where("status = 'ok'")
    text = T.distinct_blocks(T.plain_space(T.joined_lines(nfkc(T.plain_punctuation("text")))))
    return corpus.not_done(rows, done).select("url", "brand", "category", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("has_table", F.lit(False)).alias("has_table"), F.coalesce("page_type", F.lit("general_support")).alias("page_type"), F.lit("ok").alias("status"), text.alias("text"))


def chunked(normalized: DataFrame, existing: DataFrame | None = None, strategy: str | None = None) -> DataFrame:
    """All chunks after a run: of normalized (url, text and metadata; status ok), by both strategies or by
    one, with the existing chunks of the other; each content once, no near duplicate of the last 50
    kept, none without a parent. Order is the existing ones, then by address, strategy and place."""
    ok = normalized.where("status = 'ok' AND url IS NOT NULL")
    parts = []
    if strategy in (None, "fixed"):
        parts.append(_fixed(ok))
    if strategy in (None, "structure_aware"):
        made = chunking.structure_chunks(ok, "url", doc_id="url", carried=_META)
        parts.append(made.select(F.col("doc_id").alias("url"), "chunk_id", F.col("chunk_text").alias("text"), "strategy", "heading_path", "place", *_META))
    new = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # new chunks have a parent; those of the other strategy take part in any case and go at the end
    rows = new.withColumns({"age": F.lit(1), "parent": F.lit(True)})
    if existing is not None and strategy is not None:
        held = existing.where(F.col("strategy") != strategy).select(*_CHUNK).withColumns({"age": F.lit(0), "place": F.lit(0).cast("long")})
        rows = held.join(ok.select("url").distinct().withColumn("parent", F.lit(True)), "url", "left").withColumn("parent", F.coalesce("parent", F.lit(False))).unionByName(rows)
    # a chunk moves once, with its order; its verdict comes to where it lies
    rows = rows.select(F.struct("age", "url", "strategy", "place", "chunk_id").alias("order"), "text", "heading_path", *_META, "parent")
    kept = corpus.near_survivors(rows, "order", same=F.unhex(T.content_hash("text")), carried=["text", "heading_path", *_META, "parent"])
    return kept.where("kept AND parent").select("*", "id.url", "id.strategy", "id.chunk_id").select(*_CHUNK)


def _fixed(pages: DataFrame) -> DataFrame:
    chunks = chunking.fixed_chunks(pages.select("url", "text", *_META), F.col("url"))
    return chunks.select("url", "chunk_id", F.col("chunk_text").alias("text"), "strategy", F.lit(None).cast("string").alias("heading_path"), F.col("chunk_index").cast("long").alias("place"), *_META)


def fixed_with_metadata(pages: DataFrame) -> DataFrame:
    """All fixed chunks of the pages, none left out."""
    return _fixed(pages.where("url IS NOT NULL")).select(*_CHUNK)


def rebuild_index(chunks: DataFrame, path: str, dimension: int = 64, embed=hashed_vector) -> DataFrame:
    """Embeds, checks and writes the vector table anew: id, document, embedding, metadata.

    An empty table, repeated ids, vectors of another dimension or length, or another number of rows
    than there are chunks end in an error before the old table is replaced. embed: text column and
    dimension to a vector; the default hashes words.
    """
    rows = chunks.select(F.col("chunk_id").alias("id"), F.coalesce("text", F.lit("")).alias("document"), embed(T.embed_text("title", "category", "page_type", "heading_path", "text"), F.lit(dimension)).alias("embedding"), T.metadata_map().alias("metadata"))
    new = path.rstrip("/") + "_new"
    files.vector_store(rows, dimension).write.mode("overwrite").parquet(new)
    spark = chunks.sparkSession
    written = spark.read.parquet(new)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, bad = written.agg(F.count("*"), F.count_if(~norm.between(0.99, 1.01))).first()
    if not n or bad or n != chunks.count():
        raise ValueError(f"{n} vectors for {chunks.count()} chunks, {bad} of them not normalised")
    files.replace(spark, new, path)
    return spark.read.parquet(path)


def vectors_of_items(items: DataFrame, keys: list[str], dimension: int = 64, embed=hashed_vector) -> DataFrame:
    """id, document, embedding and metadata of items (id, text, metadata as a map), of which the keys stay."""
    kept = F.map_filter("metadata", lambda k, v: k.isin(keys))
    rows = items.select("id", F.coalesce("text", F.lit("")).alias("document"), embed(F.coalesce("text", F.lit("")), F.lit(dimension)).alias("embedding"), kept.alias("metadata"))
    return files.vector_store(rows, dimension)


def export_embed_ready(chunks: DataFrame, path: str) -> None:
    """The chunks with what an embedding model reads, as JSON lines."""
    shown = T.metadata_prefix("brand", "category", "page_type", "heading_path", "text")
    chunks.withColumn("embed_text", shown).write.mode("overwrite").json(path)


def robots_gate(urls: DataFrame, rules: DataFrame, answers: DataFrame) -> DataFrame:
    """urls (url) with allowed. rules: host, path (a prefix) and allow; the longest prefix decides, an
    allowing one among equals. answers: host and status of its robots file: one that is missing (404)
    allows all, another failure denies the host; a host without an answer counts as failed."""
    rows = urls.withColumn("host", F.lower(F.try_parse_url("url", F.lit("HOST")))).withColumn("path", F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")))
    rows = rows.withColumn("path", F.when(F.col("path") == "", "/").otherwise(F.col("path")))
    hit = (F.col("u.host") == F.col("r.host")) & F.startswith(F.col("u.path"), F.col("r.path"))
    best = rows.alias("u").join(rules.alias("r"), hit).groupBy(F.col("u.url").alias("url")).agg(F.max(F.struct(F.length("r.path").alias("n"), F.col("r.allow").alias("allow"))).alias("best"))
    joined = rows.join(best, "url", "left").join(answers.select("host", F.col("status").alias("code")), "host", "left")
    return joined.withColumn("allowed", F.when(F.col("code") == 404, True).when(F.col("code") == 200, F.coalesce(F.col("best.allow"), F.lit(True))).otherwise(False)).drop("host", "path", "best", "code")


def is_pdf(url: Column | str, content_type: Column | str) -> Column:
    return F.coalesce(F.contains(F.lower(T.col(content_type)), F.lit("pdf")), F.lit(False)) | F.lower(F.coalesce(F.try_parse_url(T.col(url), F.lit("PATH")), F.lit(""))).endswith(".pdf")
