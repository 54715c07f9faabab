"""A client of the HTTP interface; a stored null comes back as None, a failure as an error."""

from __future__ import annotations

import json
from typing import Any
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen

from waypost.errors import WaypostError


class Client:
    def __init__(self, address: str, timeout: float = 300.0):
        self.address, self.timeout = address.rstrip("/"), timeout

    def ask(self, target: str, body: dict[str, Any] | None = None) -> Any:
        data = None if body is None else json.dumps(body).encode()
        try:
            with urlopen(Request(self.address + target, data, {"Content-Type": "application/json"}), timeout=self.timeout) as reply:
                envelope = json.load(reply)
        except HTTPError as e:
            envelope = json.load(e)
        if not envelope["success"]:
            raise WaypostError(envelope["error"])
        return envelope["data"]

    def get(self, path: str) -> Any:
        return self.ask(f"/api/get?path={quote(path, safe='')}")

    def set(self, path: str, value: Any) -> None:
        self.ask("/api/set", {"path": path, "value": value})

    def query(self, text: str) -> Any:
        return self.ask("/api/query", {"query": text})

    def list(self, prefix: str = "") -> list[str]:
        return self.ask(f"/api/list?path={quote(prefix, safe='')}")

    def health(self) -> str:
        return self.ask("/health")
