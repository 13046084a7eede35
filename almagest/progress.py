"""Progress of a conversion: snapshots to callbacks, at most one every tenth of a second; a callback's error never stops the work."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

log = logging.getLogger(__name__)
EVERY_S = 0.1


@dataclass(frozen=True)
class Progress:
    phase: str
    done: int
    total: int

    @property
    def fraction(self) -> float:
        return min(1.0, max(0.0, self.done / self.total)) if self.total > 0 else 0.0

    @property
    def percent(self) -> float:
        return 100 * self.fraction


class Tracker:
    def __init__(self, *callbacks: Callable[[Progress], None], clock: Callable[[], float] = time.monotonic) -> None:
        self.callbacks, self._clock, self._last = list(callbacks), clock, float("-inf")

    def add(self, callback: Callable[[Progress], None]) -> None:
        self.callbacks.append(callback)

    def remove(self, callback: Callable[[Progress], None]) -> None:
        if callback in self.callbacks:
            self.callbacks.remove(callback)

    def emit(self, progress: Progress, force: bool = False) -> bool:
        now = self._clock()
        if not force and now - self._last < EVERY_S:
            return False
        self._last = now
        for callback in self.callbacks:
            try:
                callback(progress)
            except Exception:
                log.exception("a progress callback failed")
        return True
