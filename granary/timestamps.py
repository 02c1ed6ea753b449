"""Times of creation and change, put into documents and updates; off unless asked for."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any


@dataclass(frozen=True)
class Timestamps:
    created: str = "created_at"
    updated: str = "updated_at"
    now: Callable[[], datetime] = field(default=lambda: datetime.now(UTC))

    def on_insert(self, doc: Mapping[str, Any], now: datetime | None = None) -> dict[str, Any]:
        """A key that the document has stays as it is."""
        now = now or self.now()
        return {**doc, **{k: now for k in (self.created, self.updated) if k not in doc}}

    def on_update(self, update: Mapping[str, Any], now: datetime | None = None) -> dict[str, Any]:
        given = dict(update.get("$set") or {})
        if any(self.updated in (v or {}) for v in update.values() if isinstance(v, Mapping)):
            return dict(update)
        return {**update, "$set": {**given, self.updated: now or self.now()}}
