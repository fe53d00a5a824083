"""The two tools over JSON-RPC, one message a line."""

from __future__ import annotations

import json
import sys
from typing import IO

from loamdex.api import Engine, EngineError

TOOLS = [
    {
        "name": "search_docs",
        "description": "Searches the indexed pages by meaning.",
        "inputSchema": {
            "type": "object",
            "properties": {"query": {"type": "string"}, "site_id": {"type": "integer"}, "sites_filter": {"type": "string", "description": "part of a site's name or address"}, "limit": {"type": "integer", "minimum": 1}},
            "required": ["query"],
            "additionalProperties": False,
        },
    },
    {"name": "list_sites", "description": "Lists the indexed sites.", "inputSchema": {"type": "object", "properties": {}}},
]


def arguments(given: dict) -> dict:
    """Arguments of a search; optional ones of another type are left out, a limit below 1 is 1."""
    if not isinstance(given.get("query"), str):
        raise EngineError("query is missing")
    out = {"query": given["query"]}
    for name, kind in (("site_id", int), ("sites_filter", str)):
        if isinstance(given.get(name), kind) and not isinstance(given.get(name), bool):
            out[name] = given[name]
    limit = given.get("limit")
    out["limit"] = max(1, limit) if isinstance(limit, int) and not isinstance(limit, bool) else 10
    return out


def call(engine: Engine, name: str, given: dict) -> dict:
    """The tool's content; requests that can't be met are results with isError."""
    if name == "search_docs":
        args = arguments(given)
        try:
            rows = [json.loads(x) for x in engine.search(**args).toJSON().collect()]
        except EngineError as e:
            return {"content": [{"type": "text", "text": str(e)}], "isError": True}
        return {"content": [{"type": "text", "text": json.dumps({"results": rows}, indent=2)}], "isError": False}
    if name == "list_sites":
        rows = [json.loads(x) for x in engine.list_sites().toJSON().collect()]
        return {"content": [{"type": "text", "text": json.dumps({"sites": rows}, indent=2)}], "isError": False}
    raise EngineError(f"no tool {name}")


def answer(engine: Engine, message: dict) -> dict | None:
    method, params = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    try:
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "loamdex", "version": "0.1.0"}}
        elif method == "tools/list":
            result = {"tools": TOOLS}
        elif method == "tools/call":
            result = call(engine, params.get("name", ""), params.get("arguments") or {})
        elif method == "ping":
            result = {}
        else:
            return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"no method {method}"}}
    except EngineError as e:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32602, "message": str(e)}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve(engine: Engine, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    for line in source:
        if line.strip():
            reply = answer(engine, json.loads(line))
            if reply is not None:
                print(json.dumps(reply), file=sink, flush=True)
