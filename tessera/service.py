"""A resident service: one session, named frames, requests as lines of JSON over a local socket.

Request: {"v": 1, "id": ..., "cmd": "load", ...arguments}. Reply: {"v": 1, "id": ..., "ok": true, "data": ...} or
{"v": 1, "id": ..., "ok": false, "error": {"code": ..., "message": ...}}.
"""

from __future__ import annotations

import json
import os
import socket
import socketserver
import threading
from typing import Any

from .catalog import Catalog
from .errors import EngineError, ProtocolError

VERSION = 1
_ARGUMENTS = {
    "load": ("name", "path", "separator", "header"), "pipe": ("source", "target", "chain", "json"), "save": ("name", "path", "separator"),
    "list": (), "drop": ("name",), "show": ("name", "n"), "info": ("name",), "status": (),
}


def handle(catalog: Catalog, line: str, stop: threading.Event | None = None) -> dict[str, Any]:
    """The reply to one request line; errors become replies."""
    rid = None
    try:
        try:
            request = json.loads(line)
        except ValueError as e:
            raise ProtocolError(f"the request is no JSON: {e}") from e
        if not isinstance(request, dict):
            raise ProtocolError("a request is an object")
        rid = request.get("id")
        if request.get("v") != VERSION:
            raise ProtocolError(f"version {request.get('v')} isn't spoken here; {VERSION} is")
        cmd = request.get("cmd")
        if cmd == "shutdown":
            if stop is not None:
                stop.set()
            catalog.clear()
            return {"v": VERSION, "id": rid, "ok": True, "data": {"stopping": True}}
        if cmd not in _ARGUMENTS:
            raise ProtocolError(f"no command {cmd!r}; there are: {', '.join([*_ARGUMENTS, 'shutdown'])}")
        given = {k: request[k] for k in _ARGUMENTS[cmd] if k in request}
        try:
            data = getattr(catalog, cmd)(**given)
        except TypeError as e:
            raise ProtocolError(f"{cmd} takes: {', '.join(_ARGUMENTS[cmd])}") from e
        reply = {"v": VERSION, "id": rid, "ok": True, "data": data}
        if isinstance(data, dict) and data.get("overwritten"):
            reply["warning"] = f"{data['name']} was there before and is replaced"
        return reply
    except EngineError as e:
        return {"v": VERSION, "id": rid, "ok": False, "error": {"code": e.code, "message": str(e), "exit": e.exit_code}}
    except Exception as e:  # a failed job must not end the service
        return {"v": VERSION, "id": rid, "ok": False, "error": {"code": "internal", "message": str(e).splitlines()[0], "exit": 1}}


class _Handler(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        for raw in self.rfile:
            reply = handle(self.server.catalog, raw.decode("utf-8"), self.server.stop)
            self.wfile.write((json.dumps(reply) + "\n").encode())
            self.wfile.flush()
            if self.server.stop.is_set():
                threading.Thread(target=self.server.shutdown, daemon=True).start()
                return


class Server(socketserver.ThreadingUnixStreamServer):
    daemon_threads = True

    def __init__(self, path: str, catalog: Catalog):
        if os.path.exists(path):
            os.unlink(path)
        super().__init__(path, _Handler)
        os.chmod(path, 0o600)
        self.catalog, self.stop = catalog, threading.Event()


def request(path: str, cmd: str, **arguments: Any) -> dict[str, Any]:
    """Sends one command to the service at ``path`` and waits for the reply."""
    with socket.socket(socket.AF_UNIX, socket.SOCK_STREAM) as s:
        try:
            s.connect(path)
        except OSError as e:
            raise ProtocolError(f"no service at {path}") from e
        s.sendall((json.dumps({"v": VERSION, "id": 1, "cmd": cmd, **arguments}) + "\n").encode())
        with s.makefile("r", encoding="utf-8") as f:
            return json.loads(f.readline())
