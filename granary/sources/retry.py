"""Opening a source again when its server does not answer."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from ..errors import mapped
from ..events import Events

Found = TypeVar("Found")


@dataclass(frozen=True)
class Retry:
    """Waits grow by ``factor`` up to ``most_s``; each is shortened by chance by up to a half, so that clients spread."""

    # The usual policy.
    tries: int = 10
    first_s: float = 1.0
    most_s: float = 30.0
    factor: float = 2.0
    sleep: Callable[[float], None] = time.sleep

    def wait(self, attempt: int) -> float:
        return min(self.most_s, self.first_s * self.factor ** (attempt - 1)) * random.uniform(0.5, 1)

    def run(self, call: Callable[[], Found], events: Events) -> Found:
        """What the call gives; errors that a retry can help are met by more attempts, all others raised at once."""
        began, attempt = time.monotonic(), 0
        while True:
            try:
                found = call()
            except Exception as e:
                if not mapped(e).retryable or attempt >= self.tries:
                    raise
                attempt += 1
                wait = self.wait(attempt)
                events.emit("reconnecting", backend="spark", attempt=attempt, most=self.tries, delay_ms=wait * 1000)
                self.sleep(wait)
                continue
            if attempt:
                events.emit("reconnected", backend="spark", attempts=attempt, down_ms=(time.monotonic() - began) * 1000)
            return found
