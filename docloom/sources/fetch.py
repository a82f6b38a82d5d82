"""Fetching from hosts: one host, one task, one address at a time.

A list of addresses is a data source (format `fetch`) with a partition for each host; a table of
addresses is dealt by host. Both wait between two requests to a host, and make an answer of every
address: a request that fails has no code and says why.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from importlib import import_module
from urllib.error import HTTPError
from urllib.parse import urlparse
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ANSWER = "url string, host string, code int, content_type string, content string, error string, asked_at double"
DELAY, TIMEOUT = 1.0, 20.0
#: code, content type and content of an address, within a number of seconds.
Transport = Callable[[str, float], tuple[int, str, str]]


def over_http(url: str, timeout: float) -> tuple[int, str, str]:
    try:
        with urlopen(Request(url, headers={"User-Agent": "docloom"}), timeout=timeout) as answer:
            kind = answer.headers.get("Content-Type", "")
            return answer.status, kind, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except HTTPError as e:
        return e.code, e.headers.get("Content-Type", ""), ""


def host_of(url: str | None) -> str:
    try:
        return (urlparse(url or "").hostname or "").lower()
    except ValueError:
        return ""


def politely(urls: Iterator[str], transport: Transport, delay: float, timeout: float) -> Iterator[tuple]:
    """An answer for each address; two requests to one host start at least delay seconds apart."""
    last: dict[str, float] = {}
    for url in urls:
        host = host_of(url)
        if not host:
            yield url, host, None, None, None, "no host", None
            continue
        wait = last.get(host, -delay) + delay - time.monotonic() if host in last else 0
        if wait > 0:
            time.sleep(wait)
        last[host] = time.monotonic()
        at = time.time()
        try:
            yield url, host, *transport(url, timeout), None, at
        except Exception as e:  # noqa: BLE001  whatever a transport raises is the answer of its address
            yield url, host, None, None, None, f"{type(e).__name__}: {e}", at


def named(transport: str) -> Transport:
    """module:function"""
    module, _, function = transport.partition(":")
    return getattr(import_module(module), function)


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = json.loads(options.get("urls", "[]"))
        self.delay, self.timeout = float(options.get("delay", DELAY)), float(options.get("timeout", TIMEOUT))
        self.transport = options.get("transport", f"{__name__}:over_http")

    def partitions(self) -> list[InputPartition]:
        by: dict[str, list[str]] = {}
        for url in dict.fromkeys(self.urls):
            by.setdefault(host_of(url), []).append(url)
        return [_Host(urls) for urls in by.values()] or [_Host([])]

    def read(self, partition: _Host) -> Iterator[tuple]:
        yield from politely(iter(partition.urls), named(self.transport), self.delay, self.timeout)


class FetchSource(DataSource):
    """Options: urls (a JSON array, as a configuration has them), delay, timeout, transport (module:function).
    Register it with spark.dataSource.register(FetchSource)."""

    @classmethod
    def name(cls) -> str:
        return "fetch"

    def schema(self) -> str:
        return ANSWER

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fetched(urls: DataFrame, transport: Transport = over_http, delay: float = DELAY, timeout: float = TIMEOUT, tasks: int | None = None) -> DataFrame:
    """The answers (see ANSWER) of a table of addresses (url), each asked once. All addresses of a host meet
    in one task, where hosts take turns so that they wait at the same time; a null address has none."""
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    rows = urls.where("url IS NOT NULL").select("url").distinct().withColumn("host", host)
    dealt = rows.repartition(tasks, "host") if tasks else rows.repartition("host")
    # the first of every host, then the second of every host
    nth = F.expr("row_number() OVER (PARTITION BY host ORDER BY url)")
    dealt = dealt.withColumn("nth", nth).sortWithinPartitions("nth", "host").select("url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = (u for batch in batches for u in batch.column(0).to_pylist())
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64()]
        names = [c.split()[0] for c in ANSWER.split(", ")]
        for answer in politely(asked, transport, delay, timeout):
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(answer, kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, ANSWER)
