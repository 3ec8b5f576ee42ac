"""Search over HTTP with the standard library: /healthz, /v1/subjects, /v1/search, /mcp."""

from __future__ import annotations

import hmac
import json
import logging
import os
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from corpusspark import mcp
from corpusspark.config import Config
from corpusspark.plans.pipeline import Searcher

log = logging.getLogger(__name__)


def answer(searcher: Searcher, method: str, path: str, body: bytes, token: str, given: str | None) -> tuple[int, object]:
    """Status and JSON of a request. All but /healthz needs the bearer token; without a configured token nothing is let in."""
    if (method, path) == ("GET", "/healthz"):
        return 200, {"status": "ok"}
    if not token or not hmac.compare_digest((given or "").encode(), f"Bearer {token}".encode()):
        return 401, {"error": "unauthorized"}
    if (method, path) == ("POST", "/mcp"):
        return mcp.answer(searcher, body)
    if (method, path) == ("GET", "/v1/subjects"):
        return 200, {"subjects": searcher.list_subjects()}
    if (method, path) != ("POST", "/v1/search"):
        return 404, {"error": "not found"}
    try:
        asked = json.loads(body)
    except ValueError:
        return 400, {"error": "the body is no JSON"}
    if not isinstance(asked, dict) or not asked.get("subject") or not asked.get("query"):
        return 400, {"error": "subject and query are required"}
    try:
        return 200, {"results": searcher.search(asked["subject"], asked["query"], asked.get("k"))}
    except KeyError as e:
        return 404, {"error": e.args[0]}
    except ValueError as e:
        return 400, {"error": str(e)}
    except Exception:
        log.exception("a search failed")
        return 500, {"error": "internal error"}


def handler(searcher: Searcher, token: str) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, found = answer(searcher, method, self.path.split("?")[0], body, token, self.headers.get("Authorization"))
            out = b"" if found is None else json.dumps(found).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET: Callable[[], None] = lambda self: self._reply("GET")  # noqa: E731, N815
        do_POST: Callable[[], None] = lambda self: self._reply("POST")  # noqa: E731, N815

        def log_message(self, form: str, *args: object) -> None:
            log.info(form, *args)

    return Handler


def serve(spark: SparkSession, cfg: Config) -> None:
    """Serves until interrupted; requests run in threads, their jobs in a fair pool. The token is CORPUSSPARK_TOKEN."""
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", "search")
    ThreadingHTTPServer((cfg.server.host, cfg.server.port), handler(Searcher(spark, cfg), os.environ.get("CORPUSSPARK_TOKEN", ""))).serve_forever()
