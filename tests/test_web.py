from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import pytest

from pairlens.web import server


@pytest.fixture(scope="module")
def address(spark):
    own = server(spark, port=0, as_of=(2026, 11))
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


def post(address, path, data):
    try:
        with urllib.request.urlopen(urllib.request.Request(address + path, data, method="POST"), timeout=120) as reply:
            return reply.status, json.loads(reply.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_a_pair_is_matched(address):
    code, body = post(address, "/api/match", json.dumps({"jd": "Analyst\nRequirements:\n- SQL required", "resume": "SKILLS\nSQL"}).encode())
    assert code == 200 and body["report"]["verdict"] == "strong" and "SQL" in body["text"]


def test_bad_requests_are_refused(address, tmp_path):
    assert post(address, "/api/match", b"not json")[0] == 400
    assert post(address, "/api/match", json.dumps({"jd": " ", "resume": "x"}).encode())[0] == 400
    assert post(address, "/other", b"{}")[0] == 404
    assert post(address, "/api/match", b"x" * (5 * 1024 * 1024))[0] == 413


def test_the_page_is_served(address):
    with urllib.request.urlopen(address + "/", timeout=30) as reply:
        assert b"/api/match" in reply.read()
