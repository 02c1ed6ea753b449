"""Callbacks on the driver, receipts, and the log of operations."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import Any

# The names of events.
EVENTS = ("connected", "disconnected", "reconnecting", "reconnected", "error", "operation", "slow-query", "guardrail-blocked", "pool-status", "shutdown")
SLOW_MS = 1000


class Events:
    def __init__(self):
        self._listeners: dict[str, list[tuple[Callable, bool]]] = defaultdict(list)

    def on(self, name: str, call: Callable[[dict], Any], once: bool = False) -> None:
        if name not in EVENTS:
            raise ValueError(f"{name} is no event; there are {', '.join(EVENTS)}")
        self._listeners[name].append((call, once))

    def once(self, name: str, call: Callable[[dict], Any]) -> None:
        self.on(name, call, once=True)

    def off(self, name: str, call: Callable[[dict], Any]) -> None:
        self._listeners[name] = [x for x in self._listeners[name] if x[0] is not call]

    def emit(self, name: str, **data: Any) -> None:
        for call, once in list(self._listeners[name]):
            if once:
                self.off(name, call)
            call(data)


@dataclass(frozen=True)
class Receipt:
    """What a write did."""

    operation: str
    collection: str
    matched: int = 0
    modified: int = 0
    inserted: int = 0
    deleted: int = 0
    duration_ms: float = 0.0
    success: bool = True
    backend: str = "spark"

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


class Log:
    """Tells of each operation that ran, and again if it was slow."""

    def __init__(self, events: Events, slow_ms: float = SLOW_MS, on: bool = True):
        self.events, self.slow_ms, self.active = events, slow_ms, on

    def done(self, collection: str, operation: str, began: float, receipt: Receipt | None = None) -> None:
        if not self.active:
            return
        took = (time.monotonic() - began) * 1000
        self.events.emit("operation", collection=collection, operation=operation, duration_ms=took, receipt=receipt)
        if took >= self.slow_ms:
            self.events.emit("slow-query", collection=collection, operation=operation, duration_ms=took, threshold=self.slow_ms)
