"""A small HTTP view of a store: ``GET /health`` and ``GET /api/graph``."""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from linkweave.operators.report import dump
from linkweave.plans.pipelines import export_graph
from linkweave.sources.store import Store

#: Query parameters and the bound each sets, by mode.
_BOUNDS = {"evidence": {"max_identifiers": "max_identifiers", "max_evidence": "max_evidence", "fan_out_cap": "cap"}, "pairwise": {"max_identifiers": "max_identifiers", "max_links": "max_links", "fan_out_cap": "cap"}}


def answer(store: Store, target: str) -> tuple[int, str]:
    """Status and JSON body: 400 for an unknown mode or a bad number, 404 for an unknown path or no run."""
    url = urlsplit(target)
    if url.path == "/health":
        return 200, dump({"status": "ok"})
    if url.path != "/api/graph":
        return 404, dump({"error": "not found"})
    given = {k: v[-1] for k, v in parse_qs(url.query).items()}
    mode = given.get("mode", "evidence")
    if mode not in _BOUNDS:
        return 400, dump({"error": f"unknown graph mode {mode!r}"})
    bounds = {}
    for name, bound in _BOUNDS[mode].items():
        if name in given:
            if not given[name].isdigit() or int(given[name]) == 0:
                return 400, dump({"error": f"{name} must be a positive number"})
            bounds[bound] = int(given[name])
    try:
        return 200, dump(export_graph(store, mode, run_id=given.get("run_id"), **bounds))
    except LookupError as missing:
        return 404, dump({"error": str(missing)})


def server(store: Store, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            status, body = answer(store, self.path)
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
