"""Fourteen tools for agents: names, schemas of their arguments, and one function that runs them."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import date
from typing import Any

from pyspark.sql import Row

from .engine import OPERATIONS, Engine
from .errors import GranaryError, mapped

PREFIX = "granary_"
_NAME = {"type": "string", "description": "Name of the collection"}
_FILTER = {"type": "object", "description": 'Filter, like {"role": "admin", "age": {"$gte": 18}}'}
_UPDATE = {"type": "object", "description": "Changes by $set, $inc, $unset, $push and $pull"}
_SORT = {"type": "object", "description": 'Fields with 1 or -1, like {"age": -1}'}
_DOC = {"type": "object", "description": "A document"}
_DOCS = {"type": "array", "items": _DOC}
_WHOLE = {"type": "integer", "minimum": 0}


def _tool(what: str, needed: tuple[str, ...] = (), **properties: Any) -> dict[str, Any]:
    return {"description": what, "input_schema": {"type": "object", "properties": properties, "required": list(needed), "additionalProperties": False}}


_ONE, _BOTH = ("collection",), ("collection", "filter")
TOOLS = {
    PREFIX + name: tool
    for name, tool in {
        "describe": _tool("Fields, indexes and size of a collection. Call this first.", _ONE, collection=_NAME),
        "validate": _tool("Check an operation without running it.", _ONE, collection=_NAME, filter=_FILTER, update=_UPDATE, doc=_DOC),
        "explain": _tool("The plan of a query.", _ONE, collection=_NAME, filter=_FILTER, sort=_SORT, limit=_WHOLE),
        "query_one": _tool("The first document that matches, or null.", _BOTH, collection=_NAME, filter=_FILTER, sort=_SORT),
        "query_many": _tool("Documents that match. A limit is needed.", (*_BOTH, "limit"), collection=_NAME, filter=_FILTER, sort=_SORT, limit=_WHOLE, skip=_WHOLE),
        "count": _tool("How many documents match.", _ONE, collection=_NAME, filter=_FILTER),
        "insert_one": _tool("Add a document.", ("collection", "doc"), collection=_NAME, doc=_DOC),
        "insert_many": _tool("Add documents.", ("collection", "docs"), collection=_NAME, docs=_DOCS),
        "update_one": _tool("Change one document.", (*_BOTH, "update"), collection=_NAME, filter=_FILTER, update=_UPDATE, upsert={"type": "boolean"}),
        "update_many": _tool("Change all documents that match.", (*_BOTH, "update"), collection=_NAME, filter=_FILTER, update=_UPDATE),
        "delete_one": _tool("Remove one document.", _BOTH, collection=_NAME, filter=_FILTER),
        "delete_many": _tool("Remove all documents that match; the filter must not be empty.", _BOTH, collection=_NAME, filter=_FILTER),
        "batch": _tool("Run several writes, all or none.", ("operations",), operations={"type": "array", "items": {"type": "object", "properties": {"operation": {"enum": list(OPERATIONS)}, "collection": _NAME}, "required": ["operation", "collection"]}}),
        "status": _tool("How the engine is."),
    }.items()
}
_KINDS = {"string": str, "object": Mapping, "array": list, "integer": int, "boolean": bool}


def _check(name: str, args: Mapping[str, Any]) -> None:
    schema = TOOLS[name]["input_schema"]
    for k in schema["required"]:
        if k not in args:
            raise GranaryError("VALIDATION_ERROR", f'{name} needs "{k}".', f"Give {', '.join(schema['required'])}.")
    for k, v in args.items():
        if k not in schema["properties"]:
            raise GranaryError("VALIDATION_ERROR", f'{name} has no "{k}".', f"Use {', '.join(schema['properties'])}.")
        kind = schema["properties"][k]["type"]
        if v is not None and (not isinstance(v, _KINDS[kind]) or (kind == "integer" and isinstance(v, bool))):
            raise GranaryError("VALIDATION_ERROR", f'"{k}" of {name} must be {kind}.', "Give a value of that type.")


def _plain(value: Any) -> Any:
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, Mapping):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    if isinstance(value, date):
        return value.isoformat()
    return value if value is None or isinstance(value, str | int | float | bool) else str(value)


def handle_tool_call(engine: Engine, name: str, args: Mapping[str, Any] | None = None) -> str:
    """The tool's answer as JSON; what goes wrong is an answer too, with its fix."""
    args = {k: v for k, v in (args or {}).items() if v is not None}
    try:
        if name not in TOOLS:
            raise GranaryError("UNSUPPORTED_OPERATION", f'There is no tool "{name}".', f"Use {', '.join(TOOLS)}.")
        _check(name, args)
        call, rest = name.removeprefix(PREFIX), {k: v for k, v in args.items() if k not in ("collection", "filter")}
        target = [args["collection"]] if "collection" in args else []
        if call in ("validate", "explain"):
            found = getattr(engine, call)(*target, filter=args.get("filter"), **rest)
        else:
            if "filter" in TOOLS[name]["input_schema"]["properties"]:
                target.append(args.get("filter"))
            found = getattr(engine, call)(*target, **rest)
        if call == "query_many":
            found = found.collect()  # at most the limit
        elif hasattr(found, "as_dict"):
            found = found.as_dict()
        return json.dumps({"ok": True, "result": _plain(found)})
    except Exception as e:
        error = mapped(e)
        return json.dumps({"ok": False, "error": {"code": error.code, "message": error.message, "fix": error.fix, "retryable": error.retryable}})
