"""A model behind a service: a server on this machine that is busy, slow or refuses."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from prosemill.operators.simplifier import Busy, Endpoint, JsonService


class Handler(BaseHTTPRequestHandler):
    seen: dict = {}
    open_ = most = 0
    lock = threading.Lock()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        text = body["text"]
        with self.lock:
            n = self.seen[text] = self.seen.get(text, 0) + 1
            Handler.open_ += 1
            Handler.most = max(Handler.most, Handler.open_)
        time.sleep(2.0 if text == "slow" else 0.02)
        with self.lock:
            Handler.open_ -= 1
        code = 503 if text == "busy" and n < 3 or text == "always busy" else 400 if text == "bad" else 200
        try:
            self.send_response(code)
            if code == 503:
                self.send_header("Retry-After", "0")
            self.end_headers()
            self.wfile.write(json.dumps({"answer": f"{text} for {body['audience']}"}).encode())
        except BrokenPipeError:
            pass

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def service(url):
    return JsonService(url, lambda t, a: {"text": t, "audience": a}, lambda got: got["answer"])


def test_service(url):
    e = Endpoint("m", service(url), attempts=4, pause=0.01, seconds=0.5)
    assert e.one("plain", "children") == ("plain for children", None)
    assert e.one("busy", "children") == ("busy for children", None) and Handler.seen["busy"] == 3
    assert e.one("always busy", "children") == (None, "error") and Handler.seen["always busy"] == 4
    assert e.one("slow", "children") == (None, "timeout")
    assert e.one("bad", "children") == (None, "error") and Handler.seen["bad"] == 1
    with pytest.raises(Busy):
        service(url)("always busy", "x", 1.0)


def test_answers_keep_order_and_are_few_at_once(spark, url):
    keys = spark.createDataFrame([("m", "all", f"text {i}") for i in range(40)] + [("m", "all", "bad")], "model string, audience string, text string").coalesce(1)
    Handler.most = 0
    got = Endpoint("m", service(url), in_flight=4, seconds=5.0).answers(keys).collect()
    assert [r.text for r in got] == [f"text {i}" for i in range(40)] + ["bad"]
    assert all(r.answer == f"{r.text} for all" and r.failure is None for r in got[:-1]) and (got[-1].answer, got[-1].failure) == (None, "error")
    assert 1 < Handler.most <= 4
