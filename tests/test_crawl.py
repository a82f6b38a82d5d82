"""The crawl against a plain queue, and fetching by host."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.functions.udfs import page_links
from docloom.operators import crawl
from docloom.plans import catalog
from docloom.sources import fetch

SEEDS = "brand string, category string, turn long, url string"


def queue_crawl(seeds, pages, links, budget, done=()):
    """One crawl after the other, one address at a time."""
    saved, out, order = set(done), [], {}
    for brand, category, _, url in sorted((s for s in seeds if s[3]), key=lambda s: s[2]):
        order.setdefault((brand, category), []).append(url)
    for (brand, category), queue in order.items():
        visited, queue = [], list(queue)
        while queue and len(visited) < budget:
            url = queue.pop(0)
            if url in visited or url in saved:
                continue
            visited.append(url)
            ok = url in pages
            out.append((brand, category, len(visited), url, "ok" if ok else "failed"))
            if ok:
                saved.add(url)
                if not url.endswith(".pdf"):
                    queue += links(url)
    return sorted(out, key=str)


def shown(rows):
    return sorted(((r["brand"], r["category"], r["visit"], r["url"], r["status"]) for r in rows.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_crawl_is_a_queue(spark, seed):
    rng = random.Random(seed)
    hosts = ["http://a.x", "http://b.x", "http://c.x"]
    names = [f"{h}/{k}" + (".pdf" if k % 7 == 3 else "") for h in hosts for k in range(14)]
    graph = {u: [rng.choice(names) for _ in range(rng.randint(0, 5))] for u in names}
    there = [u for u in names if rng.random() < 0.8]
    own = lambda u: [v for v in graph[u] if v[:10] == u[:10]]
    html = [(u, "".join(f'<a href="{v}#top">x</a>' for v in graph[u])) for u in there]
    # two crawls share the first host, one is on its own, one has no brand
    seeds = [("p", "one", 1, names[0]), ("p", "two", 2, names[1]), ("p", "one", 3, names[5]), ("q", "one", 4, names[20]), ("p", "two", 5, names[0]), (None, "one", 6, names[30]), ("q", "one", 7, None)]
    pages = spark.createDataFrame(html, "url string, html string")
    for budget in (1, 4, 60):
        got = crawl.crawl(spark.createDataFrame(seeds, SEEDS), crawl.from_table(pages), crawl.links_on(), budget=budget)
        assert shown(got) == queue_crawl(seeds, dict(html), own, budget), budget


def test_manifest_robots_and_no_seeds(spark):
    pages = spark.createDataFrame([("http://a.x/1", '<a href="/2">x</a><a href="/3">x</a><a href="http://b.x/9">x</a>'), ("http://a.x/2", "two"), ("http://a.x/3", "three"), ("http://a.x/4", "")], "url string, html string")
    seeds = spark.createDataFrame([("p", "c", 1, "http://a.x/1"), ("p", "c", 2, "http://a.x/4")], SEEDS)
    done = spark.createDataFrame([("http://a.x/2", "ok"), ("http://a.x/3", "failed")], "url string, status string")
    closed = lambda urls: urls.withColumn("allowed", ~F.endswith("url", F.lit("3")))
    got = crawl.crawl(seeds, crawl.from_table(pages), crawl.links_on(), done=done, allowed=closed)
    assert shown(got) == [("p", "c", 1, "http://a.x/1", "ok"), ("p", "c", 2, "http://a.x/4", "ok"), ("p", "c", 3, "http://a.x/3", "failed")]
    row = got.where("visit = 1").first()
    assert row["local_path"].startswith("p/c/") and row["local_path"].endswith(".html") and row["content_hash"] and row["depth"] == 0
    assert crawl.crawl(seeds.limit(0), crawl.from_table(pages), crawl.links_on()).collect() == []


def test_registered_query_is_a_queue(spark):
    d = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{d}/pages.parquet").withColumn("links", page_links("html", "url")).withColumn("host", crawl.host_of("url")).orderBy("page_id").collect()
    by, at = {}, {}
    for p in pages:
        by.setdefault(p["host"], []).append(p["url"])
    for host, urls in by.items():
        at |= {u: (host, i) for i, u in enumerate(urls)}
    html = {p["url"]: p["links"] for p in pages}

    def links(u):
        host, i = at[u]
        return [v for v in html[u] if fetch.host_of(v) == host] + by[host][i + 1 : i + 4]

    seeds = [(h, "all", i + 1, u) for h, urls in by.items() for i, u in enumerate(urls[:2])]
    assert shown(catalog.QUERIES["crawl_pages"](spark, d)) == queue_crawl(seeds, html, links, crawl.BUDGET)


def transport(url, timeout):
    if url.endswith("bad"):
        raise TimeoutError("too slow")
    if url.endswith("404"):
        return 404, "text/html", ""
    return 200, "text/html", f"page of {url}"


URLS = [f"http://h{k % 3}.x/{k}" for k in range(9)] + ["http://h0.x/bad", "http://h1.x/404", "no address"]


def test_data_source_has_a_partition_for_each_host(spark):
    spark.dataSource.register(fetch.FetchSource)
    read = spark.read.format("fetch").option("urls", json.dumps([*URLS, URLS[0]])).option("delay", "0.05").option("transport", "tests.test_crawl:transport").load()
    rows = read.withColumn("task", F.spark_partition_id()).collect()
    check_answers(rows, 0.05)
    assert len({r["task"] for r in rows}) == len({r["host"] for r in rows}) == 4


def test_a_table_is_fetched_by_host(spark):
    urls = spark.createDataFrame([(u,) for u in [*URLS, URLS[0], None]], "url string")
    rows = fetch.fetched(urls, transport, delay=0.05, tasks=2).withColumn("task", F.spark_partition_id()).collect()
    check_answers(rows, 0.05)
    assert fetch.fetched(urls.limit(0), transport).collect() == []


def check_answers(rows, delay):
    got = {r["url"]: r for r in rows}
    assert len(rows) == len(got) == len(URLS)
    assert got["http://h0.x/bad"]["code"] is None and "too slow" in got["http://h0.x/bad"]["error"] and got["http://h0.x/bad"]["content"] is None
    assert got["http://h1.x/404"]["code"] == 404 and got["no address"]["error"] == "no host" and got[URLS[0]]["content"] == f"page of {URLS[0]}"
    for host in {r["host"] for r in rows} - {""}:
        assert len({r["task"] for r in rows if r["host"] == host}) == 1
        times = sorted(r["asked_at"] for r in rows if r["host"] == host)
        assert all(b - a > delay * 0.8 for a, b in zip(times, times[1:]))
