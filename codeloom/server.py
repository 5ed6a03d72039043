"""A tool server: one process that answers JSON-RPC requests, a line each, over its standard streams.

The session stays up between calls.  Before each call the graph's version is looked at, and the graph is
loaded again when it has moved on, so updates by other processes are seen.
"""

from __future__ import annotations

import inspect
import json
import types
import typing
from collections.abc import Iterable
from typing import Any, TextIO

from codeloom.operators.embed import Provider
from codeloom.operators.freeform import QueryError
from codeloom.store import GraphStore
from codeloom.tools import Tools

# The protocol's version, methods and error codes.
PROTOCOL = "2024-11-05"
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, BAD_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603

JSON_TYPES = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}


class Fault(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def json_type(hint: Any) -> dict[str, Any]:
    """The JSON schema of a type hint; any value where there is none."""
    kinds = typing.get_args(hint) if isinstance(hint, types.UnionType) else (hint,)
    names = [JSON_TYPES[k] for k in (typing.get_origin(k) or k for k in kinds) if k in JSON_TYPES]
    if not names:
        return {}
    if type(None) in kinds:
        names.append("null")
    return {"type": names[0] if len(names) == 1 else names}


def schema_of(name: str) -> dict[str, Any]:
    """The arguments of a tool, read from its signature."""
    method = getattr(Tools, name)
    hints = typing.get_type_hints(method)
    arguments = [a for a in inspect.signature(method).parameters.values() if a.name != "self"]
    properties = {}
    for a in arguments:
        properties[a.name] = json_type(hints.get(a.name, inspect.Parameter.empty))
        if a.default not in (inspect.Parameter.empty, None):
            properties[a.name]["default"] = a.default
    required = [a.name for a in arguments if a.default is inspect.Parameter.empty]
    return {"type": "object", "properties": properties, "required": required, "additionalProperties": False}


class Server:
    def __init__(self, store: GraphStore, project: str, provider: Provider | None = None) -> None:
        self.store, self.project, self.provider = store, project, provider
        self.version, self._tools = -1, None

    def tools(self) -> Tools:
        """The tools over the current version of the graph."""
        version = self.store.version()
        if self._tools is None or version != self.version:
            self.version, self._tools = version, Tools(self.store.load(), self.project, self.provider)
        return self._tools

    def call(self, name: Any, arguments: Any) -> dict[str, Any]:
        if name not in Tools.NAMES:
            raise Fault(BAD_PARAMS, f"no tool {name!r}")
        schema = schema_of(name)
        if not isinstance(arguments, dict) or set(arguments) - set(schema["properties"]) or set(schema["required"]) - set(arguments):
            raise Fault(BAD_PARAMS, f"{name} takes {list(schema['properties'])} and needs {schema['required']}")
        try:
            tools = self.tools()
            if name != "describe_schema" and not tools.project_exists():
                return self.answer(f"project {self.project!r} is not in the graph", True)
            return self.answer(getattr(tools, name)(**arguments), False)
        except QueryError as error:
            return self.answer({"error": error.code, "detail": str(error)}, True)
        except Exception as error:
            return self.answer({"error": type(error).__name__, "detail": str(error)}, True)

    @staticmethod
    def answer(value: Any, failed: bool) -> dict[str, Any]:
        text = value if isinstance(value, str) else json.dumps(value, default=str)
        return {"content": [{"type": "text", "text": text}], "isError": failed}

    def result(self, method: str, params: dict[str, Any]) -> dict[str, Any]:
        match method:
            case "initialize":
                return {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "codeloom", "version": "1"}}
            case "ping":
                return {}
            case "tools/list":
                return {"tools": [{"name": n, "description": n.replace("_", " "), "inputSchema": schema_of(n)} for n in Tools.NAMES]}
            case "tools/call":
                return self.call(params.get("name"), params.get("arguments") or {})
        raise Fault(NO_METHOD, f"no method {method!r}")

    def handle(self, line: str) -> dict[str, Any] | None:
        """The reply to a line; none to a notification."""
        try:
            request = json.loads(line)
        except ValueError as error:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(error)}}
        if not isinstance(request, dict) or not isinstance(request.get("method"), str) or not isinstance(request.get("params", {}), dict):
            return {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID_REQUEST, "message": "not a request"}}
        if "id" not in request:
            return None
        reply = {"jsonrpc": "2.0", "id": request["id"]}
        try:
            return reply | {"result": self.result(request["method"], request.get("params", {}))}
        except Fault as error:
            return reply | {"error": {"code": error.code, "message": str(error)}}

    def serve(self, lines: Iterable[str], out: TextIO) -> None:
        """Answers until the lines end."""
        for line in lines:
            if line.strip() and (reply := self.handle(line)) is not None:
                out.write(json.dumps(reply) + "\n")
                out.flush()
