"""Requests -> (status, JSON text), and a small server around them.

K is cut to 100 and more than two edits are refused here, not in the engine.
"""

from __future__ import annotations

import json
import logging
import queue
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, Invalid
from ..schema import DEFAULT_K, DEFAULT_WEIGHT, MAX_K, MAX_TYPO
from .engine import Engine

#: A request that takes longer is given up.
REQUEST_TIMEOUT_S = 2.0
log = logging.getLogger(__name__)


def hits_json(hits: DataFrame) -> DataFrame:
    """One row ``json``: the array of ordered hits ``(rank, term, score[, distance])``,
    at most a hundred."""
    fields = [c for c in ("term", "score", "distance") if c in hits.columns]
    ordered = hits.agg(F.sort_array(F.collect_list(F.struct("rank", F.struct(*fields).alias("hit")))).alias("hs"))
    return ordered.select(F.to_json(F.col("hs.hit")).alias("json"))


def _number(value, name: str, least: int, most: int) -> int:
    if isinstance(value, str):
        if not (value.isascii() and value.isdigit()):
            raise Invalid(f"{name} must be a number")
        value = int(value)
    if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most:
        raise Invalid(f"{name} must be a number from {least} to {most}")
    return value


def index(engine: Engine, tenant: str, body: str) -> tuple[int, str]:
    try:
        call = json.loads(body)
        term = call["term"]
    except (ValueError, KeyError, TypeError) as e:
        raise Invalid("the body must be a JSON object with a term") from e
    if not isinstance(term, str):
        raise Invalid("term must be a string")
    engine.index(tenant, term, _number(call.get("weight", DEFAULT_WEIGHT), "weight", 0, 2**63 - 1))
    return 202, ""


def query(engine: Engine, tenant: str, params: dict[str, str]) -> tuple[int, str]:
    if "prefix" not in params:
        raise Invalid("prefix is required")
    k = min(_number(params.get("k", str(DEFAULT_K)), "k", 0, 2**63 - 1), MAX_K)
    typo = _number(params.get("typo", "0"), "typo", 0, 2**32 - 1)
    if typo > MAX_TYPO:
        raise Invalid(f"typo must be at most {MAX_TYPO}")
    if typo:
        hits = engine.query_fuzzy(tenant, params["prefix"], typo, k)
    else:
        hits = engine.query(tenant, params["prefix"], k)
    return 200, "[" + ",".join(r[0] for r in hits.select(F.to_json(F.struct(*hits.columns))).collect()) + "]"


def delete(engine: Engine, tenant: str, term: str) -> tuple[int, str]:
    engine.delete(tenant, term)
    return 204, ""


def health(engine: Engine) -> tuple[int, str]:
    tenants = [r.asDict() for r in engine.stats().collect()]
    return 200, json.dumps({"status": "ok", "tenants": tenants})


def _route(engine: Engine, method: str, target: str, body: str) -> tuple[int, str]:
    parts = urlsplit(target)
    path = [unquote(p) for p in parts.path.split("/")[1:]]
    params = {k: v[-1] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    try:
        match method, path:
            case "GET", ["health"]:
                return health(engine)
            case "POST", ["v1", tenant, "index"]:
                return index(engine, tenant, body)
            case "GET", ["v1", tenant, "query"]:
                return query(engine, tenant, params)
            case "DELETE", ["v1", tenant, "term", term]:
                return delete(engine, tenant, term)
        return 404, json.dumps({"error": "no such route"})
    except EngineError as e:
        return e.status, json.dumps(e.body())


def handle(engine: Engine, method: str, target: str, body: str = "", timeout_s: float = REQUEST_TIMEOUT_S) -> tuple[int, str]:
    """Routes a request; errors become their status and ``{"error": message}``. One that
    takes too long is answered with 408, and its jobs are cancelled. Each is logged."""
    group, started = f"request-{uuid.uuid4().hex}", time.monotonic()
    context = engine.spark.sparkContext
    answers: queue.Queue = queue.Queue()

    def work() -> None:
        context.setJobGroup(group, f"{method} {target}", interruptOnCancel=True)
        try:
            answers.put(_route(engine, method, target, body))
        except Exception as e:  # the caller's thread has to hear of it
            answers.put(e)

    threading.Thread(target=work, daemon=True).start()
    try:
        answer = answers.get(timeout=timeout_s)
    except queue.Empty:
        context.cancelJobGroup(group)
        answer = 408, ""
    if isinstance(answer, Exception):
        raise answer
    log.info("%s %s %d %.1f ms", method, target, answer[0], (time.monotonic() - started) * 1000)
    return answer


def server(engine: Engine) -> ThreadingHTTPServer:
    """A server for ``config.bind_addr``; call ``serve_forever`` on it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, text = handle(engine, self.command, self.path, self.rfile.read(size).decode())
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(text.encode())))
            self.end_headers()
            self.wfile.write(text.encode())

        do_GET = do_POST = do_DELETE = _answer  # noqa: N815

    host, _, port = engine.config.bind_addr.rpartition(":")
    return ThreadingHTTPServer((host, int(port)), Handler)
