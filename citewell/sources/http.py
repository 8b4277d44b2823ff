"""Pages over HTTP, politely: a host's pages are fetched one after another, whatever the
number of tasks, and what has been fetched stays fetched.

Rows are dealt by host, so that one task has all of a host's pages and can keep the delay
between them; hosts share tasks, and while one waits the next is served. ``fetch_into`` works in
waves of hosts, each stored when it is done: a run that was stopped goes on where it was.
"""

from __future__ import annotations

import heapq
import time
import urllib.error
import urllib.request
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from citewell import ship
from citewell.config import Settings
from citewell.errors import FetchError
from citewell.operators.durable import durable
from citewell.schemas import PAGE

ACCEPT = "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"


class Reply(NamedTuple):
    """What came of one request; ``trouble`` is null where a page came."""

    final_url: str | None = None
    html: str | None = None
    status: int | None = None
    trouble: str | None = None


def open_url(url: str, s: Settings) -> tuple[str, str, int]:
    """final url, html, status; redirects are followed."""
    request = urllib.request.Request(url, headers={"User-Agent": s.user_agent, "Accept": ACCEPT})
    with urllib.request.urlopen(request, timeout=s.fetch_timeout_s) as reply:
        charset = reply.headers.get_content_charset() or "utf-8"
        return reply.url, reply.read().decode(charset, errors="replace"), reply.status


def ask(url: str, s: Settings, get: Callable = open_url) -> Reply:
    """One request, its failure as a value."""
    try:
        reply = Reply(*get(url, s))
    except urllib.error.HTTPError as e:
        return Reply(status=e.code, trouble=f"status {e.code}")
    except (OSError, ValueError) as e:
        return Reply(trouble=f"{type(e).__name__} ({e})")
    return reply if reply.status // 100 == 2 else Reply(status=reply.status, trouble=f"status {reply.status}")


def waits(attempts: int) -> list[float]:
    """Seconds before each attempt: none before the first, then 1, 2, 4, ..."""
    return [0.0, *(2.0**k for k in range(attempts - 1))][: max(attempts, 0)]


def fetch(url: str, s: Settings = Settings(), get: Callable = open_url, sleep: Callable = time.sleep) -> tuple[str, str, int]:
    """final url, html and status of a page, asked for as often as the settings say."""
    reply = Reply(trouble="never asked")
    for seconds in waits(s.fetch_retries):
        if seconds:
            sleep(seconds)
        reply = ask(url, s, get)
        if reply.trouble is None:
            return reply.final_url, reply.html, reply.status
    raise FetchError(f"gave up on {url}: {reply.trouble}")


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").netloc.rpartition("@")[2]).lower()
    except ValueError:
        return ""


def polite(
    rows: list[tuple], s: Settings, get: Callable = open_url, sleep: Callable = time.sleep, clock: Callable = time.monotonic,
    due: dict[str, float] | None = None,
) -> Iterator[tuple]:
    """Fetch (scheme_id, url) rows, a host's at least the delay apart: whichever host may be
    asked first is served next. ``due`` remembers hosts from one call to the next."""
    due, by = {} if due is None else due, defaultdict(deque)
    for row in rows:
        by[host_of(row[1])].append(row)
    ready = [(due.get(host, 0.0), k, host) for k, host in enumerate(by)]
    heapq.heapify(ready)
    while ready:
        at, k, host = heapq.heappop(ready)
        if at > clock():
            sleep(at - clock())
        scheme_id, url = by[host].popleft()
        try:
            yield scheme_id, url, *fetch(url or "", s, get, sleep), None
        except FetchError as e:
            yield scheme_id, url, None, None, None, str(e)
        due[host] = clock() + s.fetch_delay_s
        if by[host]:
            heapq.heappush(ready, (due[host], k, host))


def _host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#]*)", 1))


def read_pages(sources: DataFrame, s: Settings = Settings(), get: Callable = open_url) -> DataFrame:
    """scheme_id, url, final_url, html, status, error for each row of ``sources`` (scheme_id,
    url). A page that fails has an error and no html. Each use of the result fetches again."""
    schema = to_arrow_schema(PAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        due: dict[str, float] = {}
        for b in batches:
            rows = list(zip(b.column("scheme_id").to_pylist(), b.column("url").to_pylist(), strict=True))
            for row in polite(rows, s, get, due=due):
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    ship()
    return sources.select("scheme_id", "url").repartition(_host()).mapInArrow(run, PAGE)


def fetch_into(sources: DataFrame, path: str, s: Settings = Settings(), waves: int = 1, get: Callable = open_url) -> DataFrame:
    """All pages of ``sources`` as stored in ``path``, where those still missing are fetched
    first: hosts in ``waves``, each stored when it is done. Failures are not stored; they are
    in the result of the run that met them, in ``error``, and the next run tries them again."""
    spark, key = sources.sparkSession, ["scheme_id", "url"]
    rows = sources.select(*key).distinct()
    spark.createDataFrame([], PAGE).write.mode("append").parquet(path)  # a folder to read, even if nothing comes
    failed = spark.createDataFrame([], PAGE)
    for k in range(waves):
        wave = rows.where(F.pmod(F.xxhash64(_host()), F.lit(waves)) == k)
        missing = wave.join(spark.read.schema(PAGE).parquet(path).select(*key), key, "left_anti")
        got = durable(read_pages(missing, s, get), "pages")
        got.where("error IS NULL").write.mode("append").parquet(path)
        failed = failed.unionByName(got.where("error IS NOT NULL"))
    return spark.read.schema(PAGE).parquet(path).join(rows, key, "left_semi").unionByName(failed)
