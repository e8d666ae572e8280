"""Crawls against servers of this machine, which note when each host is asked."""

import threading
import time
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from corpusloom.sources import crawl, web

PAUSE = 0.4


@pytest.fixture
def servers():
    """Three hosts, told apart by their ports, and the times of the requests to each."""
    asked, running = defaultdict(list), []

    class Page(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.server.server_port].append((time.time(), self.path))
            good = not self.path.startswith("/gone")
            body = f"<html><head><meta name='keywords' content='a, b'></head><article><p>page {self.path}</p></article></html>".encode()
            self.send_response(200 if good else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    for _ in range(3):
        s = ThreadingHTTPServer(("127.0.0.1", 0), Page)
        threading.Thread(target=s.serve_forever, daemon=True).start()
        running.append(s)
    yield [s.server_port for s in running], asked
    for s in running:
        s.shutdown()
        s.server_close()


def clients():
    """A function that workers can take, as they don't have this module."""

    def connect():
        return web.http_get(timeout=5, pause=(0, 0)), lambda url: [url.replace("/gone", "/archived")]

    return connect


def table(spark, urls):
    rows = [(k, "m", "2024-01-01", None, u) for k, u in enumerate(urls)]
    return spark.createDataFrame(rows, "id long, media_name string, publish_date string, title string, url string")


def gaps(times):
    at = sorted(t for t, _ in times)
    return [b - a for a, b in zip(at, at[1:])]


def test_a_host_is_asked_at_its_pace_from_several_tasks(spark, servers, tmp_path):
    ports, asked = servers
    urls = [f"http://127.0.0.1:{ports[0]}/{k}" for k in range(14)] + [f"http://127.0.0.1:{p}/{k}" for p in ports[1:] for k in range(4)]
    urls += [f"http://127.0.0.1:{ports[1]}/gone", "no host", None]
    out = crawl.crawl(table(spark, urls).repartition(5), str(tmp_path / "out"), clients(), pause=PAUSE, round_seconds=60, lane_rows=4, tasks=6)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(urls) and got[3]["body"] == "page /3" and got[3]["keywords"] == ["a", "b"] and got[3]["error"] is None
    assert got[22]["body"] == "page /archived" and got[23]["error"] == got[24]["error"] == web.FAILED
    assert [len(asked[p]) for p in ports] == [14, 6, 4]
    planned = crawl.plan(table(spark, urls), PAUSE, 60, 4)
    assert planned.where(f"url like '%:{ports[0]}/%'").select("lane").distinct().count() > 1  # the hot host is in several lanes
    for p in ports:
        assert min(gaps(asked[p])) > PAUSE * 0.5  # a slot is a pause, less what the network varies
        for t, _ in asked[p]:
            assert sum(t <= u < t + 1 for u, _ in asked[p]) <= 1 / PAUSE + 1


def test_a_crawl_goes_on_where_it_stopped(spark, servers, tmp_path):
    ports, asked = servers
    urls = table(spark, [f"http://127.0.0.1:{ports[0]}/{k}" for k in range(6)] + [f"http://127.0.0.1:{ports[1]}/gone{k}" for k in range(2)] + [None])
    where = str(tmp_path / "out")
    first = crawl.crawl(urls, where, clients(), pause=0.1, round_seconds=0.3, most_rounds=1)
    assert 0 < first.count() < 9 and first.where(f"url like '%:{ports[0]}/%'").count() == 3
    whole = crawl.crawl(urls, where, clients(), pause=0.1, round_seconds=0.3)
    assert sorted(r["id"] for r in whole.collect()) == list(range(9))
    assert sorted(p for _, p in asked[ports[0]]) == [f"/{k}" for k in range(6)]  # none twice
    n = sum(map(len, asked.values()))
    assert crawl.crawl(urls, where, clients(), pause=0.1).count() == 9 and sum(map(len, asked.values())) == n
    assert crawl.crawl(urls.limit(0), str(tmp_path / "none"), clients()).count() == 0


def test_slots_of_lanes_do_not_meet():
    taken = []
    for lane in range(3):
        last = -1
        for now in (0.0, 0.1, 0.35, 2.0, 2.05):
            last = crawl._next_slot(now, 0.0, last, lane, 3, 0.5)
            assert last % 3 == lane and last * 0.5 >= now
            taken.append(last)
    assert len(set(taken)) == len(taken)


def test_hosts(spark):
    urls = ["http://A.example:80/x", "https://u:p@b.example?q=://c", "//d", None, "http://", "e.example/x://y"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(crawl.host_of(crawl.F.col("u"))).collect()
    assert [r[0] for r in got] == ["a.example:80", "b.example", None, None, "", ""]
