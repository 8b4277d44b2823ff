"""Fetching from a local server, the command line over it, and numbers of rows in files."""

import argparse
import json
import threading
import time
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from citewell import cli
from citewell.config import Settings
from citewell.errors import ConfigError, FetchError
from citewell.operators.ordinals import by_file, numbered
from citewell.sources import tables
from citewell.sources.http import fetch, fetch_into, polite, read_pages, waits

PAGE = "<html><body><main><h1>{0}</h1><p>" + "Fact 5% stands here. " * 40 + "</p></main></body></html>"


@pytest.fixture
def server():
    """A server that records times by host name, and fails paths with ``bad``."""
    seen = defaultdict(list)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.headers["Host"]].append((time.monotonic(), self.path, self.headers["User-Agent"]))
            body = PAGE.format(self.path).encode()
            self.send_response(503 if "bad" in self.path else 200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield http.server_port, seen
    http.shutdown()


def test_attempts_wait_longer_each_time():
    waited, replies = [], iter([("u", "", 500), OSError("x"), ("final", "<p>", 200)])

    def get(url, s):
        r = next(replies)
        if isinstance(r, Exception):
            raise r
        return r

    assert waits(3) == [0.0, 1.0, 2.0] and waits(0) == []
    assert fetch("u", get=get, sleep=waited.append) == ("final", "<p>", 200) and waited == [1.0, 2.0]
    with pytest.raises(FetchError, match="404"):
        fetch("u", get=lambda *_: ("u", "", 404), sleep=waited.append)


def test_hosts_are_served_in_turn():
    now, calls = [0.0], []

    def get(url, s):
        calls.append((now[0], url))
        return url, "", 200

    def sleep(seconds):
        now[0] += seconds

    rows = [("a", f"http://one.example/{k}") for k in range(3)] + [("b", "http://two.example/")]
    done = list(polite(rows, Settings(fetch_delay_s=2.0), get, sleep, lambda: now[0]))
    assert len(done) == 4
    assert calls == [(0.0, rows[0][1]), (0.0, rows[3][1]), (2.0, rows[1][1]), (4.0, rows[2][1])]


def test_a_host_is_never_asked_twice_within_the_delay(spark, server, tmp_path):
    port, seen = server
    s = Settings(fetch_delay_s=0.2, fetch_retries=1, user_agent="tester")
    urls = [f"http://{h}:{port}/{k}" for h in ("127.0.0.1", "localhost") for k in range(4)] + [f"http://localhost:{port}/bad"]
    sources = spark.createDataFrame([(str(k), u) for k, u in enumerate(urls)], "scheme_id string, url string").repartition(4)
    pages = fetch_into(sources, str(tmp_path / "pages"), s, waves=2)
    got = {r.url: r for r in pages.collect()}
    assert len(got) == 9 and sum(r.error is None for r in got.values()) == 8 and "503" in got[urls[-1]].error
    for host, times in seen.items():
        at = [t for t, _, _ in times]
        assert all(b - a >= 0.19 for a, b in zip(at, at[1:], strict=False)), host
        assert {agent for _, _, agent in times} == {"tester"}
    before = sum(map(len, seen.values()))
    assert fetch_into(sources, str(tmp_path / "pages"), s).where("error IS NULL").count() == 8
    assert sum(map(len, seen.values())) == before + 1  # only what had failed
    none = read_pages(sources.limit(0), s).collect()
    assert none == []


def test_ingest_twice_fetches_once(spark, server, tmp_path, monkeypatch):
    port, seen = server
    manifest = tmp_path / "m.csv"
    manifest.write_text("scheme_id,scheme_name,category,plan,url\n" + "".join(f"s{k},N{k},c,p,http://127.0.0.1:{port}/{k}\n" for k in range(3)))
    spark.conf.set("spark.citewell.fetch_delay_s", "0")
    try:
        a = argparse.Namespace(manifest=str(manifest), documents=str(tmp_path / "docs"), store=str(tmp_path / "store"), force=False)
        assert cli.ingest(spark, a) == 0
        first = sum(map(len, seen.values()))
        assert first == 3 and tables.load_documents(spark, str(tmp_path / "docs")).count() == 3
        assert cli.ingest(spark, a) == 0
        assert sum(map(len, seen.values())) == first and tables.load_documents(spark, str(tmp_path / "docs")).count() == 3
        a.force = True
        assert cli.ingest(spark, a) == 0 and sum(map(len, seen.values())) == 2 * first
        (report,) = [json.loads(line) for f in (tmp_path / "docs-report").glob("*.json") for line in f.read_text().splitlines()]
        assert report["sources_ok"] == 3
    finally:
        spark.conf.unset("spark.citewell.fetch_delay_s")


def test_rows_of_files_are_numbered_side_by_side(spark, tmp_path):
    lines = [f"line {k}" for k in range(5000)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("\n".join(lines[:3000]) + "\n")
    (tmp_path / "t" / "b.txt").write_text("\n".join(lines[3000:]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = by_file(spark.read.text(str(tmp_path / "t")), "n")
        assert spark.read.text(str(tmp_path / "t")).rdd.getNumPartitions() > 4
        assert [r.value for r in rows.orderBy("n").collect()] == lines
        assert [r.n for r in rows.orderBy("n").collect()] == list(range(5000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_numbers_of_any_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("hot")).repartition(5)
    got = numbered(rows, F.col("hot"), F.col("v").desc()).orderBy("number").collect()
    assert [r.number for r in got] == list(range(1000))
    assert [(r.hot, -r.v) for r in got] == sorted((r.hot, -r.v) for r in got)
    same = numbered(rows.select(F.lit(1).alias("x")), F.col("x")).collect()
    assert sorted(r.number for r in same) == list(range(1000))
    assert numbered(rows.limit(0), F.col("v")).count() == 0


def test_the_line_of_an_empty_field(spark, tmp_path):
    (tmp_path / "m").mkdir()
    head = "scheme_id,scheme_name,category,plan,url\n"
    (tmp_path / "m" / "1.csv").write_text(head + 'a,"two\nlines",c,p,u\n')
    (tmp_path / "m" / "2.csv").write_text(head + "b,n,c,p,u\n,,,,\nc,,c,p,u\n")
    with pytest.raises(ConfigError, match=r"2\.csv line 4: empty field\(s\): scheme_name"):
        tables.read_sources(spark, str(tmp_path / "m"))
