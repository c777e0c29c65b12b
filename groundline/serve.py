"""The seven operations over JSON-RPC: line by line on standard input, or by HTTP on this machine alone."""
import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .tools import TOOLS, call

LOOPBACK = ("127.0.0.1", "localhost", "::1")


def listing() -> list:
    kinds = {str: "string", int: "integer"}
    return [{"name": n, "description": (run.__doc__ or n.replace("_", " ")).splitlines()[0],
             "inputSchema": {"type": "object", "properties": {a: {"type": kinds[k], "default": d} for a, (k, d) in takes.items()}, "additionalProperties": False},
             "annotations": {"readOnlyHint": True, "destructiveHint": False, "idempotentHint": True, "openWorldHint": False}} for n, (run, takes) in TOOLS.items()]


def answer(graph, request: dict):
    """The response to one request; None for a notification."""
    if "id" not in request:
        return None
    reply = {"jsonrpc": "2.0", "id": request["id"]}
    method, p = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": p.get("protocolVersion", "2025-06-18"), "capabilities": {"tools": {}}, "serverInfo": {"name": "groundline", "version": "0.2"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": listing()}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"there is no method {method}"}}
    try:
        got, failed = call(graph, str(p.get("name")), p.get("arguments") or {}), False
    except (KeyError, ValueError) as e:
        got, failed = {"error": str(e)}, True
    return reply | {"result": {"content": [{"type": "text", "text": json.dumps(got, ensure_ascii=False, sort_keys=True)}], "structuredContent": got, "isError": failed}}


def stdio(graph, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            r = answer(graph, json.loads(line))
        except (ValueError, AttributeError):
            r = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "this is no JSON request"}}
        if r is not None:
            print(json.dumps(r, ensure_ascii=False), file=out, flush=True)


def http(graph, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server (not yet running) with POST /mcp, GET /api/health and / going there. Other hosts than this machine's are refused."""
    if host not in LOOPBACK:
        raise ValueError("only this machine's own addresses are served")

    class Handler(BaseHTTPRequestHandler):
        def send(self, code, body=None, **head):
            data = b"" if body is None else json.dumps(body, ensure_ascii=False, sort_keys=True).encode()
            self.send_response(code)
            for k, v in {"Content-Type": "application/json", "Content-Length": str(len(data)), **head}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            if self.path == "/":
                self.send(307, Location="/api/health")
            elif self.path == "/api/health":
                self.send(200, graph.health())
            else:
                self.send(404, {"error": "not here"})

        def do_POST(self):
            if self.path.rstrip("/") != "/mcp":
                return self.send(404, {"error": "not here"})
            try:
                r = answer(graph, json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0))))
            except (ValueError, AttributeError):
                return self.send(400, {"error": "this is no JSON request"})
            self.send(202 if r is None else 200, r)

        def log_message(self, *_):
            pass
    return ThreadingHTTPServer((host, port), Handler)
