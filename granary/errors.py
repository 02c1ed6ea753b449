"""Errors that carry a code, whether a retry can help, and how to put things right."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame

# The codes, and which of them a retry can help.
CODES = (
    "CONNECTION_FAILED",
    "CONNECTION_LOST",
    "AUTHENTICATION_FAILED",
    "TIMEOUT",
    "POOL_EXHAUSTED",
    "DUPLICATE_KEY",
    "VALIDATION_ERROR",
    "COLLECTION_NOT_FOUND",
    "QUERY_ERROR",
    "GUARDRAIL_BLOCKED",
    "UNKNOWN_OPERATOR",
    "UNSUPPORTED_OPERATION",
    "INTERNAL_ERROR",
    "SCHEMA_MISMATCH",
)
RETRYABLE = ("CONNECTION_FAILED", "CONNECTION_LOST", "TIMEOUT", "POOL_EXHAUSTED")

#: Verbs that may stand for those of this engine's methods.
_VERBS = {
    "query": ("query", "find", "get", "fetch", "read", "select", "search", "scan", "where", "list", "load"),
    "insert": ("insert", "add", "append", "create", "put", "save", "write", "store"),
    "update": ("update", "modify", "set", "patch", "change", "replace", "merge", "upsert"),
    "delete": ("delete", "remove", "drop", "erase", "purge"),
    "count": ("count", "size", "length", "total"),
    "batch": ("batch", "bulk"),
}
#: Words that tell of one row, and options of reads.
_ONE, _OPTIONS = ("one", "first", "single"), ("sort", "limit", "skip", "projection")
OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$regex", "$options", "$not", "$size", "$type", "$all", "$elemMatch", "$mod", "$bitsAllSet", "$bitsAnySet", "$bitsAllClear", "$bitsAnyClear", "$and", "$or", "$nor", "$expr")


class GranaryError(Exception):
    def __init__(self, code: str, message: str, fix: str, *, collection: str | None = None, operation: str | None = None, original: BaseException | None = None):
        super().__init__(f"{message} Fix: {fix}")
        self.code, self.fix, self.message = code, fix, message
        self.collection, self.operation, self.original = collection, operation, original
        self.retryable = code in RETRYABLE
        self.backend = "spark"
        self.timestamp = datetime.now(UTC)


def closest(name: str, among: Iterable[str], most: int = 3) -> str | None:
    """The nearest of some names by edits, if it takes no more than ``most`` of them."""
    best = min(((distance(name.lower(), c.lower()), c) for c in among), default=(most + 1, None))
    return best[1] if best[0] <= most else None


def distance(a: str, b: str) -> int:
    """Least number of characters to insert, delete or replace."""
    kept = range(len(b) + 1)
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b):
            now.append(min(now[j] + 1, kept[j + 1] + 1, kept[j] + (x != y)))
        kept = now
    return kept[-1]


def _method_like(name: str) -> str | None:
    """The method that a name's last verb stands for, of one row or of many."""
    words = re.findall(r"[a-z]+", re.sub(r"([A-Z])", r"_\1", name).lower())
    found = [ours for w in words for ours, verbs in _VERBS.items() if w in verbs]
    if "batch" in found or not found:
        return "batch" if found else None
    if found[-1] == "count":
        return "count"
    return f"{found[-1]}_{'one' if any(w in _ONE for w in words) else 'many'}"


def unknown_method(name: str) -> GranaryError:
    near = _method_like(name)
    fix = f"Call {near}() here." if near else "Read with query_one, query_many or count, write with the insert, update and delete methods or batch, and see describe, validate and explain."
    return GranaryError("UNSUPPORTED_OPERATION", f"Engine has no attribute {name!r}.", fix)


def _instead_of(stage: str) -> str | None:
    """What does the work of a pipeline stage: an option of reads, or else a method of the DataFrame that a read returns."""
    name = stage.removeprefix("$")
    option = next((o for o in _OPTIONS if o.startswith(name)), None)
    if option:
        return f"Pass {option}= to the read."
    method = next((m for m in sorted(dir(DataFrame)) if m[:1] != "_" and m.lower().startswith(name.lower())), None)
    return f"Reads return DataFrames: use their {method}()." if method else None


def unknown_operator(name: str, collection: str | None = None) -> GranaryError:
    near = difflib.get_close_matches(name, OPERATORS, 1)
    fix = (f"Did you mean {near[0]}? " if near else "") or (_instead_of(name) or "")
    return GranaryError("UNKNOWN_OPERATOR", f'Unknown operator "{name}".', f"{fix} Operators of filters are {', '.join(OPERATORS)}.".strip(), collection=collection)


def collection_not_found(name: str, known: Iterable[str]) -> GranaryError:
    known = sorted(known)
    near = closest(name, known)
    fix = f"Perhaps {near!r} is meant. " if near else ""
    fix += f"This engine knows {', '.join(known)}." if known else "Create it with ensure_collections or by a first insert."
    return GranaryError("COLLECTION_NOT_FOUND", f"No table {name!r} is known to this engine.", fix, collection=name)


def unknown_field(name: str, known: Iterable[str], collection: str | None = None) -> GranaryError:
    known = list(known)
    near = closest(name, known)
    return GranaryError("QUERY_ERROR", f'Unknown field "{name}".', (f'Did you mean "{near}"? ' if near else "") + f"Fields: {', '.join(known)}.", collection=collection)


#: Spark's error conditions and what they are here.
_CONDITIONS = (
    ("TABLE_OR_VIEW_NOT_FOUND", "COLLECTION_NOT_FOUND", "Check the collection's name."),
    ("PATH_NOT_FOUND", "COLLECTION_NOT_FOUND", "Check the path that the collection is bound to."),
    ("UNRESOLVED_COLUMN", "QUERY_ERROR", "Check the names of fields with describe()."),
    ("CAST_INVALID_INPUT", "QUERY_ERROR", "Compare a field with a value of its own type."),
    ("INCOMPATIBLE_DATA_FOR_TABLE", "SCHEMA_MISMATCH", "Give the fields the types that describe() shows."),
    ("CANNOT_MERGE_SCHEMAS", "SCHEMA_MISMATCH", "Give the fields the types that describe() shows."),
    ("NUM_COLUMNS_MISMATCH", "SCHEMA_MISMATCH", "Give each row all fields of the collection."),
    ("ARITHMETIC_OVERFLOW", "QUERY_ERROR", "Use a wider type for the field."),
    ("DATATYPE_MISMATCH", "QUERY_ERROR", "Compare a field with a value of its own type."),
    ("PARSE_SYNTAX_ERROR", "QUERY_ERROR", "Check the statement."),
    ("NOT_NULL", "VALIDATION_ERROR", "Give each required field a value."),
)
_WORDS = (
    ("authentication", "AUTHENTICATION_FAILED", "Check user and password."),
    ("permission denied", "AUTHENTICATION_FAILED", "Check user and password."),
    ("timed out", "TIMEOUT", "Add a filter, or allow more time."),
    ("connection refused", "CONNECTION_FAILED", "Check the address and that the server runs."),
    ("connection reset", "CONNECTION_LOST", "Try again."),
    ("sparkcontext was shut down", "CONNECTION_LOST", "Start a new session."),
)


def mapped(error: BaseException, collection: str | None = None, operation: str | None = None) -> GranaryError:
    """The error as one of ours; ours stay as they are."""
    if isinstance(error, GranaryError):
        return error
    condition = str(getattr(error, "getCondition", lambda: "")() or "")
    text = str(error)
    for name, code, fix in _CONDITIONS:
        if name in condition or f"[{name}" in text:
            return GranaryError(code, text.split("\n")[0][:300], fix, collection=collection, operation=operation, original=error)
    for words, code, fix in _WORDS:
        if words in text.lower():
            return GranaryError(code, text.split("\n")[0][:300], fix, collection=collection, operation=operation, original=error)
    return GranaryError("INTERNAL_ERROR", text.split("\n")[0][:300] or type(error).__name__, "See the original error.", collection=collection, operation=operation, original=error)
