"""Opt-in extensions by entry point: nothing is loaded unless a caller asks for it by name.

Group ``almagest.extensions``: ``gpstime`` gives a callable that turns its own time objects into ``GpsTime``; ``telemetry`` gives a context manager factory ``span(name)``. A missing or broken
extension leaves the built-in behaviour.
"""

from __future__ import annotations

import contextlib
import functools
import logging
from collections.abc import Callable, Iterator
from importlib.metadata import EntryPoint, entry_points
from typing import Any

from almagest.functions.gpstime import GpsTime

GROUP = "almagest.extensions"
log = logging.getLogger(__name__)
_active: dict[str, Any] = {}


def available() -> dict[str, EntryPoint]:
    return {e.name: e for e in entry_points(group=GROUP)}


def enable(name: str, value: Any = None) -> bool:
    """Loads an installed extension, or takes ``value`` as it; False, and a line in the log, where that fails."""
    if value is None:
        try:
            value = available()[name].load()
        except Exception as e:
            log.warning("extension %s is not available: %s", name, e)
            return False
    _active[name] = value
    return True


def disable(name: str) -> None:
    _active.pop(name, None)


def as_gps_time(when: Any) -> GpsTime:
    """What ``GpsTime.of`` takes, or anything that the gpstime extension turns into one."""
    return GpsTime.of(_active["gpstime"](when) if "gpstime" in _active and not isinstance(when, GpsTime) else when)


@contextlib.contextmanager
def span(name: str) -> Iterator[None]:
    """A telemetry span around a block, if that extension is on."""
    with _active["telemetry"](name) if "telemetry" in _active else contextlib.nullcontext():
        yield


def spanned(fn: Callable) -> Callable:
    """A function that runs in a span of its name."""

    @functools.wraps(fn)
    def run(*args: Any, **more: Any) -> Any:
        with span(f"{fn.__module__}.{fn.__qualname__}"):
            return fn(*args, **more)

    return run
