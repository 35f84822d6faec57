"""Tools over standard input and output: JSON-RPC lines, four read-only tools, every answer bounded in bytes.

search and context rank chunks of a store, info tells what it holds, fetch gives a chunk's whole text. An answer that would exceed ``cap`` bytes keeps its best-ranked hits. A request that can't be
answered gets an error object, and the next one is served.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import functions as F

from webskein.engine import Engine
from webskein.sources.records import bounded_json

CAP = 65_536
SHOWN = ("rank", "score", "chunk_id", "text", "heading", "canonical_url", "document_title")


def _text(args: dict, name: str) -> str:
    if not isinstance(x := args.get(name), str) or not x.strip():
        raise ValueError(f"{name}: a text is needed")
    return x


def _number(args: dict, name: str, default: int, most: int) -> int:
    x = args.get(name, default)
    if isinstance(x, bool) or not isinstance(x, int) or not 1 <= x <= most:
        raise ValueError(f"{name}: a number from 1 to {most} is needed")
    return x


class Tools:
    def __init__(self, engine: Engine, cap: int = CAP):
        self.engine, self.cap = engine, cap
        self.of: dict[str, Callable[[dict], object]] = {"search": self.search, "context": self.context, "info": self.info, "fetch": self.fetch}

    def search(self, args: dict) -> list[dict]:
        """Chunks that answer a query best."""
        hits = self.engine.search(self.engine.queries(_text(args, "query")), _number(args, "limit", 5, 50))
        return [json.loads(r.json) for r in bounded_json(hits, self.cap, SHOWN).orderBy("rank").collect()]

    def context(self, args: dict) -> dict:
        """Whole chunks for a query within a token budget."""
        hits = self.engine.search(self.engine.queries(_text(args, "query")), _number(args, "limit", 10, 50))
        rows = self.engine.build_context(hits, _number(args, "budget", 3000, 16_000)).collect()
        return rows[0].asDict(recursive=True) if rows else {"chunks": []}

    def info(self, args: dict) -> dict:
        """What the store holds."""
        return self.engine.info().first().asDict()

    def fetch(self, args: dict) -> dict:
        """A chunk by its hash."""
        found = self.engine.store.read("chunks").where(F.col("chunk_hash") == _hash(args)).limit(1).collect()
        if not found:
            raise ValueError("no such chunk")
        return found[0].asDict()

    def answer(self, line: str) -> dict:
        """The response to a request: {"id", "method": "tools/list" or "tools/call", "params": {"name", "arguments"}}."""
        key = None
        try:
            request = json.loads(line)
            key, method, params = request.get("id"), request.get("method"), request.get("params") or {}
            if method == "tools/list":
                result: object = [{"name": n, "description": f.__doc__ or n} for n, f in self.of.items()]
            elif method == "tools/call" and params.get("name") in self.of:
                result = self.of[params["name"]](params.get("arguments") or {})
            else:
                raise ValueError("unknown method or tool")
            if len(json.dumps(result, default=str).encode()) > 2 * self.cap:
                raise ValueError("the answer is too large")
            return {"jsonrpc": "2.0", "id": key, "result": result}
        except Exception as e:  # noqa: BLE001 - the next request must be served
            return {"jsonrpc": "2.0", "id": key, "error": {"code": -32000, "message": f"{type(e).__name__}: {e}"[:1000]}}


def _hash(args: dict) -> str:
    x = _text(args, "chunk_hash")
    if len(x) != 64 or set(x) - set("0123456789abcdef"):
        raise ValueError("chunk_hash: 64 hexadecimal digits are needed")
    return x


def serve(engine: Engine, source: TextIO, sink: TextIO, cap: int = CAP) -> None:
    tools = Tools(engine, cap)
    for line in source:
        if line.strip():
            sink.write(json.dumps(tools.answer(line), default=str) + "\n")
            sink.flush()
