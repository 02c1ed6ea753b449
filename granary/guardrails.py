"""What is refused unless it is confirmed: writes that touch every row, and reads without a limit."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from .errors import GranaryError
from .plans.filters import is_trivial

# The words that confirm.
CONFIRM = {"delete_many": "DELETE_ALL", "update_many": "UPDATE_ALL"}


def blocked(operation: str, spec: Mapping[str, Any] | None, *, confirm: str | None = None, limit: int | None = None) -> tuple[str, str] | None:
    """(reason, fix) if the operation must not run.

    A filter that holds for every row counts as an empty one, however it is
    written.
    """
    if operation == "query_many":
        return ("it has no limit, so its result is unbounded", "Give a limit.") if limit is None else None
    if operation in ("delete_one", "delete_many", "update_many", "update_one") and is_trivial(spec):
        if operation == "update_one":
            return None
        if operation == "delete_one":
            return "its filter matches any row", "Say which row to delete."
        if confirm != CONFIRM[operation]:
            return "its filter matches every row", f"Narrow the filter, or pass confirm='{CONFIRM[operation]}'."
    return None


def check(operation: str, collection: str, spec: Mapping[str, Any] | None, events, **options: Any) -> None:
    if found := blocked(operation, spec, **options):
        reason, fix = found
        events.emit("guardrail-blocked", collection=collection, operation=operation, reason=reason, backend="spark")
        raise GranaryError("GUARDRAIL_BLOCKED", f"{operation} on {collection} is blocked: {reason}.", fix, collection=collection, operation=operation)
