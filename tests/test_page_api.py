"""The page API's data source against a server on this machine."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from wordloom.sources import page_api


class Handler(BaseHTTPRequestHandler):
    seen = []
    until = 1000

    def do_GET(self):  # noqa: N802
        path, _, query = self.path.partition("?")
        q = {k: v[0] for k, v in urllib.parse.parse_qs(query).items()}
        Handler.seen.append((path, q))
        times = sum(x == (path, q) for x in Handler.seen)
        if q.get("titles") == "Busy" and times < 3:
            return self.answer({"error": {"code": "maxlag"}}) if times == 2 else self.answer({}, 429)
        if q.get("titles") == "Never":
            return self.answer({}, 500)
        if q.get("prop") == "links":
            at = int(q.get("plcontinue", 0))
            if q.get("titles") == "Long" and at >= Handler.until:
                return self.answer({}, 500)
            if q.get("titles") == "Long":
                more = {"continue": {"plcontinue": str(at + 2)}} if at < 20 else {}
                return self.answer({"query": {"pages": [{"links": [{"title": f"L{at}"}, {"title": f"L{at + 1}"}]}]}, **more})
            more = {"continue": {"plcontinue": str(at + 2)}} if at < 4 else {}
            return self.answer({"query": {"pages": [{"links": [{"title": f"L{at}"}, {"title": f"L{at + 1}"}]}]}, **more})
        if q.get("list") == "random":
            return self.answer({"query": {"random": [{"title": "R1"}, {"title": "R2"}]}})
        if q.get("action") == "parse":
            return self.answer({"parse": {"text": f"<p>{q['oldid']}</p>"}})
        if q.get("titles") == "Missing":
            return self.answer({"query": {"pages": [{"missing": True}]}})
        self.answer({"query": {"pages": [{"title": q["titles"], "pageid": 5, "revisions": [{"revid": 7, "timestamp": "2026-01-01T00:00:00Z"}], "fullurl": "u", "extract": f"text of {q['titles']}"}]}})

    def answer(self, body, status=200):
        self.send_response(status)
        if status == 429:
            self.send_header("Retry-After", "-1")
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def load(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(page_api.PageApi)
    url = f"http://127.0.0.1:{server.server_port}/{{lang}}/api.php"

    def read(kind, items, **more):
        return spark.read.format("page_api").options(endpoint=url, kind=kind, items=json.dumps(items), interval="0", behind="0", backoff="0", **more).load()

    read.url = url
    yield read
    server.shutdown()


def test_extracts_with_waits_and_missing_pages(load):
    rows = load("extract", [["en", "A"], ["en", "Missing"], ["hi", "Busy"]]).collect()
    assert sorted((r.lang, r.title, r.revid, r.text) for r in rows) == [("en", "A", 7, "text of A"), ("hi", "Busy", 7, "text of Busy")]
    path, asked = next(x for x in Handler.seen if x[1].get("titles") == "A")
    assert path == "/en/api.php" and asked["maxlag"] == "5" and asked["formatversion"] == "2"


def test_html_links_and_random_titles(load):
    assert [tuple(r) for r in load("html", [["en", 12]]).collect()] == [("en", 12, "<p>12</p>")]
    assert [r.target for r in load("links", [["en", "A"]]).orderBy("place").collect()] == [f"L{i}" for i in range(6)]
    assert [r.target for r in load("links", [["en", "A"]], limit="3").orderBy("place").collect()] == ["L0", "L1", "L2"]
    assert [r.title for r in load("random", [["en", 3]]).orderBy("place").collect()] == ["R1", "R2", "R1"]


def test_a_service_that_never_answers_fails(load):
    with pytest.raises(Exception, match="does not answer"):
        load("extract", [["en", "Never"]], retries="2").collect()


def test_requests_keep_their_distance():
    waits = []
    client = page_api.Client("http://127.0.0.1:9/x", 2, page_api.Waits(interval=10), sleep=waits.append)
    with pytest.raises(RuntimeError):
        client.ask({"titles": "x"})
    assert waits[0] == 0 and waits[1] == 2 and 9 < waits[2] <= 10 and waits[3] == 4


def test_waits_follow_from_the_outcome():
    """Seconds that the service asks for."""
    waits, outcome = page_api.Waits(), page_api.Outcome
    assert [waits.after(outcome("failed"), k) for k in (1, 2, 3)] == [2, 4, 6] and waits.after(outcome("behind"), 4) == 5
    assert waits.after(outcome("busy", told=7.0), 1) == 8 and waits.after(outcome("busy"), 1) == 31 and waits.after(outcome("answered", {}), 1) == 0


def test_a_stream_of_links_goes_on_where_it_stopped(spark, load, tmp_path):
    options = {"endpoint": load.url, "kind": "links", "items": json.dumps([["en", "Long"], ["hi", "A"]]), "interval": "0", "behind": "0", "backoff": "0", "retries": "1"}
    links = spark.readStream.format("page_api").options(**options).load()

    def go():
        return links.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).start()

    Handler.until = 8  # the service fails in the middle
    first = go()
    with pytest.raises(Exception, match="does not answer"):
        first.processAllAvailable()
    first.stop()
    read = lambda: [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("lang", "place").collect()]
    assert 0 < len([r for r in read() if r[0] == "en"]) <= 8
    Handler.until, asked = 1000, len(Handler.seen)
    second = go()
    second.processAllAvailable()
    second.stop()
    assert read() == [("en", "Long", i, f"L{i}") for i in range(22)] + [("hi", "A", i, f"L{i}") for i in range(6)]
    assert "plcontinue" in next(q for _, q in Handler.seen[asked:] if q.get("titles") == "Long")  # not from the beginning


def test_batches_worked_out_again_are_the_same(load):
    reader = page_api.LinkStream({"endpoint": load.url, "kind": "links", "items": json.dumps([["en", "Long"], ["hi", "A"]]), "limit": "9", "interval": "0"})
    offsets, batches = [reader.initialOffset()], []
    for _ in range(7):
        rows, end = reader.read(offsets[-1])
        batches.append(list(rows))
        offsets.append(end)
    assert [x[2:] for batch in batches for x in batch if x[0] == "en"] == [(i, f"L{i}") for i in range(9)] and batches[-1] == []
    for i in range(7):
        for j in range(i, 8):
            again = list(reader.readBetweenOffsets(offsets[i], offsets[j]))
            assert sorted(again) == sorted(x for batch in batches[i:j] for x in batch)
