"""A thin HTTP adapter: POST /api/match with {jd, resume, top} gives the report as JSON and as text.

Each request is one small Spark run on a shared session; bulk work belongs in ``plans.analyze``.
"""

from __future__ import annotations

import argparse
import datetime
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from pairlens.dims import DEFAULT, SkillDictionary
from pairlens.operators.match import MatchConfig
from pairlens.plans.analyze import analyze, every_pair
from pairlens.report import render_text, to_dict
from pairlens.sources.documents import MOST_REQUEST_BYTES, read_requests

PAGE = """<!doctype html><meta charset="utf-8"><title>pairlens</title>
<textarea id="jd" rows="12" cols="60" placeholder="posting"></textarea> <textarea id="resume" rows="12" cols="60" placeholder="resume"></textarea>
<p><button onclick="go()">match</button></p><pre id="out"></pre>
<script>
async function go() {
  const value = id => document.getElementById(id).value;
  const answer = await fetch("/api/match", {method: "POST", body: JSON.stringify({jd: value("jd"), resume: value("resume"), top: 40})});
  const body = await answer.json();
  document.getElementById("out").textContent = body.text || body.error;
}
</script>"""
#: Bytes of a refused body that are still read, so that the client sees the answer.
MOST_DRAINED = 64 * 1024 * 1024


def answer(spark: SparkSession, body: str, as_of: tuple[int, int], dictionary: SkillDictionary = DEFAULT) -> tuple[int, dict]:
    """Status and reply for one request body. A text is never taken for a path."""
    good, bad = read_requests(spark.createDataFrame([(0, body)], "request_id int, body string"))
    request = good.first()
    if request is None:
        return 400, {"error": bad.first().error}
    one = lambda text: spark.createDataFrame([("text", text)], "doc_id string, raw_text string")
    posting, resume = one(request.jd), one(request.resume)
    report = analyze(posting, resume, as_of, pairs=every_pair(posting, resume), dictionary=dictionary, config=MatchConfig(use_embeddings=False)).reports.first()
    return 200, {"report": to_dict(report), "text": render_text(report, request.top)}


def server(spark: SparkSession, host: str = "127.0.0.1", port: int = 8765, *, as_of: tuple[int, int] | None = None, dictionary: SkillDictionary = DEFAULT) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args: object) -> None:
            """Bodies are personal data; nothing is logged."""

        def reply(self, code: int, data: bytes, kind: str) -> None:
            self.send_response(code)
            for name, value in (("Content-Type", kind), ("Content-Length", str(len(data))), ("Cache-Control", "no-store"), ("X-Content-Type-Options", "nosniff")):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(data)

        def say(self, code: int, body: dict) -> None:
            self.reply(code, json.dumps(body, ensure_ascii=False).encode(), "application/json; charset=utf-8")

        def do_GET(self) -> None:
            if self.path in ("/", "/index.html"):
                self.reply(200, PAGE.encode(), "text/html; charset=utf-8")
            else:
                self.say(404, {"error": "not found"})

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_REQUEST_BYTES:
                left = min(size, MOST_DRAINED)
                while left > 0 and (part := self.rfile.read(min(left, 65536))):
                    left -= len(part)
                self.close_connection = True
                return self.say(413, {"error": "the body is too large"})
            body = self.rfile.read(size).decode("utf-8", "replace")
            if self.path != "/api/match":
                return self.say(404, {"error": "not found"})
            today = datetime.date.today()
            self.say(*answer(spark, body, as_of or (today.year, today.month), dictionary))

    return ThreadingHTTPServer((host, port), Handler)


def main(argv: list[str] | None = None) -> None:
    out = argparse.ArgumentParser(prog="pairlens-web")
    out.add_argument("--host", default="127.0.0.1")
    out.add_argument("--port", type=int, default=8765)
    out.add_argument("--skills", help="skill dictionary as JSON")
    args = out.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.shuffle.partitions", "4").getOrCreate()
    server(spark, args.host, args.port, dictionary=SkillDictionary.load(args.skills) if args.skills else DEFAULT).serve_forever()


if __name__ == "__main__":
    main()
