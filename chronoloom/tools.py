"""The graph as tools over lines of JSON-RPC, one request a line and one answer a line; notifications get none."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO

from pyspark.sql import DataFrame

from .api import Graph
from .model import GraphError
from .operators.search import QueryError

PROTOCOL = "2024-11-05"
PARSE_ERROR, UNKNOWN_METHOD, INVALID_PARAMS = -32700, -32601, -32602


class Tools:
    """Each public method is a tool: it takes the arguments of a call and gives what becomes its JSON text."""

    def __init__(self, graph: Graph):
        self.graph = graph

    def _rows(self, df: DataFrame) -> list[dict]:
        return self.graph.store.as_json(df)

    def add_episode(self, text: str, source: str | None = None, tags: list[str] | None = None) -> dict:
        """Add an episode; entities and relations are extracted where the graph can."""
        key, counts = self.graph.add_episode(text, source, tags)
        return {"episode_id": key, "entities_extracted": counts.entities, "edges_created": counts.edges}

    def search(self, query: str, limit: int = 10, source: str | None = None) -> list[dict]:
        """Episodes by words, and by meaning where the graph has vectors."""
        return self._rows(self.graph.search(query, limit, source))

    def get_decision(self, id: str) -> dict:  # noqa: A002
        """One episode with all its fields."""
        return {"episode": self._rows(self.graph.episode(id))[0]}

    def traverse(self, entity_name: str, max_depth: int = 2) -> dict:
        """Entities and edges around an entity."""
        nodes, edges = self.graph.traverse([entity_name], max_depth)
        return {"entities": self._rows(nodes), "edges": self._rows(edges)}

    def traverse_batch(self, entity_names: list[str], max_depth: int = 2) -> dict:
        """The same around several entities, merged; unknown names are skipped."""
        nodes, edges = self.graph.traverse(entity_names, max_depth, skip_unknown=True)
        return {"entities": self._rows(nodes), "edges": self._rows(edges)}

    def find_precedents(self, context: str, limit: int = 5) -> list[dict]:
        """Episodes closest in meaning to a situation."""
        return self._rows(self.graph.precedents(context, limit))

    def list_entities(self, entity_type: str | None = None, limit: int = 100, offset: int = 0) -> dict:
        """Entities, newest first, by type if one is given."""
        rows = self._rows(self.graph.store.entities(limit, entity_type, offset))
        return {"entities": rows, "count": len(rows)}

    def export_graph(self, entity_type: str | None = None, include_episodes: bool = False, limit: int = 10_000) -> dict:
        """Entities, the edges that touch them, and episodes if asked for."""
        parts = {k: self._rows(v) for k, v in self.graph.export(limit, entity_type, include_episodes).items()}
        singular = {"entities": "entity_count", "edges": "edge_count", "episodes": "episode_count"}
        return parts | {singular[k]: len(v) for k, v in parts.items()}

    NAMES = ("add_episode", "search", "get_decision", "traverse", "traverse_batch", "find_precedents", "list_entities", "export_graph")

    def described(self) -> list[dict]:
        """Name, description and input schema of every tool, from its own signature."""
        import inspect

        kinds = {"str": "string", "int": "integer", "bool": "boolean", "list[str]": "array"}
        out = []
        for name in self.NAMES:
            parameters = inspect.signature(getattr(self, name)).parameters
            fields = {p: {"type": kinds[str(v.annotation).replace(" | None", "")]} for p, v in parameters.items()}
            for f in fields.values():
                if f["type"] == "array":
                    f["items"] = {"type": "string"}
            needed = [p for p, v in parameters.items() if v.default is v.empty]
            out.append({"name": name, "description": getattr(self, name).__doc__, "inputSchema": {"type": "object", "properties": fields, **({"required": needed} if needed else {})}})
        return out

    def call(self, name: str, arguments: dict | None) -> dict:
        """A tool's result as content; what goes wrong in a tool is a result too."""
        try:
            if name not in self.NAMES:
                raise LookupError(f"unknown tool: {name}")
            made = getattr(self, name)(**(arguments or {}))
            failed = False
        except TypeError as e:
            made, failed = {"error": str(e)}, True
        except (GraphError, QueryError, LookupError, ValueError) as e:
            made, failed = {"error": str(e)}, True
        return {"content": [{"type": "text", "text": json.dumps(made, ensure_ascii=False, indent=2)}], **({"isError": True} if failed else {})}


def answer(tools: Tools, line: str) -> str | None:
    """The answer to one line; none to a notification."""
    said = lambda key, **body: json.dumps({"jsonrpc": "2.0", "id": key, **body}, ensure_ascii=False)
    error = lambda key, code, text: said(key, error={"code": code, "message": text})
    try:
        request = json.loads(line)
    except json.JSONDecodeError as e:
        return error(None, PARSE_ERROR, f"parse error: {e}")
    if not isinstance(request, dict) or not isinstance(request.get("method"), str):
        return error(None, PARSE_ERROR, "not a request")
    if "id" not in request:
        return None
    key, params = request["id"], request.get("params") or {}
    methods: dict[str, Callable[[], str]] = {
        "initialize": lambda: said(key, result={"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "chronoloom", "version": "0.2.0"}}),
        "tools/list": lambda: said(key, result={"tools": tools.described()}),
        "tools/call": lambda: said(key, result=tools.call(params["name"], params.get("arguments"))) if isinstance(params.get("name"), str) else error(key, INVALID_PARAMS, "missing tool name"),
    }
    made = methods.get(request["method"])
    return made() if made else error(key, UNKNOWN_METHOD, f"method not found: {request['method']}")


def serve(graph: Graph, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    tools = Tools(graph)
    for line in source:
        if line.strip() and (out := answer(tools, line)) is not None:
            sink.write(out + "\n")
            sink.flush()
