"""Crawling as rounds over a frontier of written tables.

A crawl takes its addresses first in, first out, up to a budget. What a page of a level links to is
taken after the whole level, in the order of the pages and of the links on them; so a level has an
order of its own before any of it is fetched, and is fetched at once, by all tasks and for all
crawls. Only crawls that share a host wait for each other, as a page that one has saved is not
saved again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import content_hash, url_hash
from docloom.functions.udfs import page_links
from docloom.scratch import Scratch

#: Pages of a crawl, failed ones too.
BUDGET = 60
_CRAWL = ["brand", "category"]

Fetch = Callable[[DataFrame], DataFrame]
Follow = Callable[[DataFrame], DataFrame]


def host_of(url: Column | str) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("HOST")), F.lit("")))


def from_table(pages: DataFrame, url: str = "url", content: str = "html") -> Fetch:
    """Answers out of a table of pages (distinct addresses) in place of a network: 200 for those it has."""
    kind = F.col("content_type") if "content_type" in pages.columns else F.lit("text/html")
    held = pages.select(F.col(url).alias("url"), F.lit(200).alias("code"), kind.alias("content_type"), F.col(content).alias("content"))
    return lambda asked: asked.join(held, "url", "left")


def links_on(followed: Column | None = None) -> Follow:
    """brand, category, visit, pos and link: the links of fetched pages to their own host that followed,
    an expression of host, link, brand and category, allows."""

    def run(rows: DataFrame) -> DataFrame:
        found = rows.select(*_CRAWL, "visit", host_of("url").alias("host"), F.posexplode(page_links("content", "url")).alias("pos", "link"))
        kept = found.where((F.col("link") != "") & (host_of("link") == F.col("host")))
        return kept if followed is None else kept.where(followed)

    return run


def _waves(seeds: DataFrame) -> dict[tuple, int]:
    """The crawls that have to wait for others, with their turn. Those that share hosts are a part of the
    configuration; crawls of their own hosts are not gathered."""
    hosts = seeds.select("turn", *_CRAWL, host_of("url").alias("host")).groupBy("host", *_CRAWL).agg(F.min("turn").alias("turn"))
    shared = hosts.groupBy("host").count().where(F.col("count") > 1).select("host")
    rows = hosts.join(shared, "host").orderBy("turn").collect()
    last: dict[str, int] = {}
    wave: dict[tuple, int] = {}
    order: dict[tuple, list[str]] = {}
    for r in rows:
        order.setdefault((r["brand"], r["category"]), []).append(r["host"])
    for crawl, own in order.items():
        wave[crawl] = max(last.get(h, -1) for h in own) + 1
        last |= {h: wave[crawl] for h in own}
    return wave


def crawl(seeds: DataFrame, fetch: Fetch, follow: Follow, done: DataFrame | None = None, allowed: Fetch | None = None, budget: int = BUDGET) -> DataFrame:
    """The manifest that crawling adds: brand, category, visit (from 1, in the order of the queue), depth,
    url, status (ok, failed), is_pdf, content_hash, local_path, content.

    seeds: brand, category, turn and url; turn orders all seeds, and a crawl comes when its first seed
    does. fetch makes of a table of urls (url) their code, content_type and content; another code than
    2xx, or none, is a failure. allowed, as fetch, gives allowed (boolean); what it forbids fails
    without being fetched. follow: see links_on; a PDF has no links. Addresses that done (a manifest)
    has as ok, and those that an earlier crawl of this run has saved, are passed over and cost nothing;
    a failed one may be tried by another crawl. Null addresses are none. An address that comes again
    counts once. An empty table of seeds gives an empty manifest.
    """
    scratch = Scratch(seeds.sparkSession, "crawl")
    seeds = scratch.keep(seeds.where("url IS NOT NULL").select(*_CRAWL, "turn", "url"), "seeds")
    waves = _waves(seeds)
    saved = [done.where("status = 'ok'").select("url")] if done is not None else []
    made: list[DataFrame] = []
    for wave in range(max(waves.values(), default=0) + 1):
        here = F.lit(wave == 0)
        for (brand, category), n in waves.items():
            here = F.when(F.col("brand").eqNullSafe(F.lit(brand)) & F.col("category").eqNullSafe(F.lit(category)), n == wave).otherwise(here)
        part = _levels(seeds.where(here), fetch, follow, saved, allowed, budget, scratch, f"w{wave}")
        made += part
        saved += [p.where("status = 'ok'").select("url") for p in part]
    out = made[0]
    for p in made[1:]:
        out = out.unionByName(p)
    return out


def _levels(seeds: DataFrame, fetch: Fetch, follow: Follow, saved: list[DataFrame], allowed: Fetch | None, budget: int, scratch: Scratch, name: str) -> list[DataFrame]:
    made: list[DataFrame] = []
    frontier = seeds.select(*_CRAWL, "url", F.struct(F.col("turn").cast("long").alias("a"), F.lit(0).alias("b")).alias("order"))
    while True:
        fresh = frontier.groupBy(*_CRAWL, "url").agg(F.min("order").alias("order"))
        for p in saved:
            fresh = fresh.join(p, "url", "left_anti")
        for p in made:  # a null brand is a brand
            fresh = fresh.join(p.select(F.col("brand").alias("b_"), F.col("category").alias("c_"), "url"), (fresh["url"] == p["url"]) & F.col("brand").eqNullSafe(F.col("b_")) & F.col("category").eqNullSafe(F.col("c_")), "left_anti")
        ranked = fresh.withColumn("place", F.row_number().over(Window.partitionBy(*_CRAWL).orderBy("order"))).where(F.col("place") <= budget)
        before = None
        for p in made:
            before = p.select(*_CRAWL) if before is None else before.unionByName(p.select(*_CRAWL))
        if before is None:
            ranked = ranked.withColumn("before", F.lit(0))
        else:
            spent = before.groupBy(F.col("brand").alias("b_"), F.col("category").alias("c_")).agg(F.count("*").alias("before"))
            ranked = ranked.join(spent, F.col("brand").eqNullSafe(F.col("b_")) & F.col("category").eqNullSafe(F.col("c_")), "left").drop("b_", "c_")
        visit = (F.coalesce("before", F.lit(0)) + F.col("place")).cast("long")
        depth = len(made)
        level = scratch.keep(ranked.withColumn("visit", visit).where(F.col("visit") <= budget).select(*_CRAWL, "visit", F.lit(depth).alias("depth"), "url"), f"{name}-{depth}")
        if made and not level.limit(1).count():
            return made
        asked = level.select("url").distinct()
        if allowed is not None:
            asked = allowed(asked).where("allowed").select("url")
        answers = fetch(asked).where("code BETWEEN 200 AND 299").select("url", "content_type", "content")
        rows = level.join(answers.withColumn("there", F.lit(True)), "url", "left")
        ok = F.col("there").isNotNull()
        is_pdf = F.coalesce(F.contains(F.col("content_type"), F.lit("application/pdf")), F.lit(False)) | F.endswith(F.lower("url"), F.lit(".pdf"))
        path = F.concat_ws("/", "brand", "category", F.concat(url_hash("url"), F.when(is_pdf, ".pdf").otherwise(".html")))
        rows = rows.select(*_CRAWL, "visit", "depth", "url", F.when(ok, "ok").otherwise("failed").alias("status"), F.when(ok, is_pdf).alias("is_pdf"), F.when(ok, content_hash(F.coalesce("content", F.lit("")))).alias("content_hash"), F.when(ok, path).alias("local_path"), F.when(ok, F.col("content")).alias("content"))
        made.append(scratch.keep(rows, f"{name}-{depth}-rows"))
        linked = follow(made[-1].where("status = 'ok' AND NOT is_pdf"))
        frontier = linked.select(*_CRAWL, F.col("link").alias("url"), F.struct(F.col("visit").alias("a"), F.col("pos").alias("b")).alias("order"))
