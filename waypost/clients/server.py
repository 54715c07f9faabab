"""The store over HTTP: its ``api_*`` envelopes at the routes of the clients' interface.

``GET /api/get?path=``, ``POST /api/set`` {path, value}, ``POST /api/query`` {query},
``GET /api/list?path=``, ``GET /health``.  One request is served at a time, so writes are in order.
"""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlsplit

from waypost.store import EndpointStore


def answer(store: EndpointStore, method: str, target: str, body: bytes = b"") -> tuple[int, dict[str, Any]]:
    """Status and envelope of a request."""
    url = urlsplit(target)
    asked = {k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
    failed = lambda code, text: (code, {"success": False, "error": text, "data": None})
    try:
        told = json.loads(body) if method == "POST" else {}
        if not isinstance(told, dict):
            raise ValueError("an object is expected")
    except ValueError as e:
        return failed(400, f"Not a request: {e}")
    routes = {
        ("GET", "/health"): ([], lambda: store.health()),
        ("GET", "/api/get"): (["path"], lambda: store.api_get(asked["path"])),
        ("GET", "/api/list"): ([], lambda: store.api_list(asked.get("path", ""))),
        ("POST", "/api/set"): (["path", "value"], lambda: store.api_set(told["path"], told["value"])),
        ("POST", "/api/query"): (["query"], lambda: store.api_query(told["query"])),
    }
    if (method, url.path) not in routes:
        return failed(404, f"No such route: {method} {url.path}")
    needed, act = routes[method, url.path]
    missing = [n for n in needed if n not in (asked if method == "GET" else told)]
    return failed(400, f"Missing: {', '.join(missing)}") if missing else (200, act())


class Server:
    """Serves a store in the background until closed; port 0 takes any free one."""

    def __init__(self, store: EndpointStore, host: str = "127.0.0.1", port: int = 0):
        one = threading.Lock()

        class Handler(BaseHTTPRequestHandler):
            def respond(self) -> None:
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                with one:
                    status, envelope = answer(store, self.command, self.path, body)
                data = json.dumps(envelope).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = respond

            def log_message(self, *_) -> None:
                pass

        self.http = ThreadingHTTPServer((host, port), Handler)
        self.address = f"http://{host}:{self.http.server_address[1]}"
        self.thread = threading.Thread(target=self.http.serve_forever, daemon=True)
        self.thread.start()

    def close(self) -> None:
        self.http.shutdown()
        self.http.server_close()

    def __enter__(self) -> Server:
        return self

    def __exit__(self, *_) -> None:
        self.close()
