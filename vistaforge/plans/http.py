"""The engine over HTTP with the standard library: POST /capabilities, /image and /images, JSON in and out."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from vistaforge.operators import serve
from vistaforge.plans.engine import Engine


def answer(engine: Engine, path: str, body: bytes) -> tuple[int, dict]:
    """(status, response) of a request; whatever is wrong with a request is a 400 that says so."""
    handlers = {"/capabilities": lambda _: serve.capabilities(), "/image": serve.echo, "/images": engine.search}
    if path not in handlers:
        return 404, {"detail": f"no such place: {path}"}
    try:
        return 200, handlers[path](json.loads(body))
    except Exception as e:
        return 400, {"detail": f"Error processing request: {e}"}


def server(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server to start with ``serve_forever``; searches of several clients run as Spark jobs side by side."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            status, response = answer(engine, self.path, self.rfile.read(int(self.headers.get("Content-Length", 0))))
            data = json.dumps(response).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    return ThreadingHTTPServer((host, port), Handler)
