"""The Model Context Protocol over HTTP: JSON-RPC messages in a POST, each answered at once; two tools, list_subjects and search."""

from __future__ import annotations

import json
import logging

from corpusspark.plans.pipeline import Searcher

log = logging.getLogger(__name__)
#: Versions of the protocol that are spoken, the latest first.
VERSIONS = ["2025-06-18", "2025-03-26", "2024-11-05"]


class _Bad(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def tools(searcher: Searcher) -> list[dict]:
    """The tools as a client sees them."""
    text = {"type": "string"}
    return [
        {"name": "list_subjects", "description": "The corpora that can be searched, and how much each has.", "inputSchema": {"type": "object", "properties": {}}},
        {
            "name": "search",
            "description": "The passages that best answer a query, with what is needed to cite them. subject: the name of a corpus, a list of names, or all.",
            "inputSchema": {
                "type": "object",
                "properties": {"subject": {"anyOf": [text, {"type": "array", "items": text}]}, "query": text, "k": {"type": "integer", "minimum": 1, "default": searcher.cfg.search.default_k}},
                "required": ["subject", "query"],
            },
        },
    ]


def _called(searcher: Searcher, name: str, given: dict) -> list[dict]:
    if name == "list_subjects":
        return searcher.list_subjects()
    if name != "search":
        raise _Bad(-32602, f"unknown tool {name!r}")
    if not given.get("subject") or not isinstance(given.get("query"), str):
        raise _Bad(-32602, "subject and query are required")
    return searcher.search(given["subject"], given["query"], given.get("k"))


def _result(searcher: Searcher, method: str, params: dict) -> dict:
    if method == "initialize":
        asked = params.get("protocolVersion")
        version = asked if asked in VERSIONS else VERSIONS[0]
        return {"protocolVersion": version, "capabilities": {"tools": {}}, "serverInfo": {"name": "corpusspark", "version": "1"}, "instructions": searcher.instructions()}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": tools(searcher)}
    if method == "tools/call":
        try:
            found = _called(searcher, params.get("name", ""), params.get("arguments") or {})
        except (KeyError, ValueError) as e:  # the tool's own errors are its result
            return {"content": [{"type": "text", "text": str(e.args[0])}], "isError": True}
        return {"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False)}], "structuredContent": {"result": found}, "isError": False}
    raise _Bad(-32601, f"unknown method {method!r}")


def _one(searcher: Searcher, message: object) -> dict | None:
    """The answer to a message, or None to a notification."""
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
    if "id" not in message:
        return None
    head = {"jsonrpc": "2.0", "id": message["id"]}
    try:
        return head | {"result": _result(searcher, message["method"], message.get("params") or {})}
    except _Bad as e:
        return head | {"error": {"code": e.code, "message": str(e)}}
    except Exception:
        log.exception("a message failed")
        return head | {"error": {"code": -32603, "message": "internal error"}}


def answer(searcher: Searcher, body: bytes) -> tuple[int, object]:
    """Status and JSON of a posted message, or of several in a list; 202 without JSON if there is nothing to answer."""
    try:
        asked = json.loads(body)
    except ValueError:
        return 400, {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "the body is no JSON"}}
    found = [r for m in (asked if isinstance(asked, list) else [asked]) if (r := _one(searcher, m)) is not None]
    if not found:
        return 202, None
    return 200, found if isinstance(asked, list) else found[0]
