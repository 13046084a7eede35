"""Logging of the command line: coloured on terminals, set up once however often it is asked for; and banners."""

from __future__ import annotations

import logging
import sys
from typing import TextIO

COLOURS = {logging.DEBUG: 36, logging.INFO: 32, logging.WARNING: 33, logging.ERROR: 31, logging.CRITICAL: 35}
WIDTH = 72


class Coloured(logging.Formatter):
    def __init__(self, colour: bool) -> None:
        super().__init__("%(asctime)s %(levelname)s %(name)s: %(message)s", "%H:%M:%S")
        self.colour = colour

    def format(self, record: logging.LogRecord) -> str:
        text = super().format(record)
        return f"\033[{COLOURS.get(record.levelno, 0)}m{text}\033[0m" if self.colour else text


def setup(level: int | str = logging.INFO, to: TextIO | None = None, colour: bool | None = None) -> logging.Logger:
    """The package's logger with one handler of ours; asked again it only changes the level, the stream and the colours."""
    logger = logging.getLogger("almagest")
    stream = to or sys.stderr
    ours = [h for h in logger.handlers if isinstance(h.formatter, Coloured)]
    handler = ours[0] if ours else logging.StreamHandler(stream)
    handler.stream = stream  # the one before may be closed by now
    handler.setFormatter(Coloured(stream.isatty() if colour is None else colour))
    if not ours:
        logger.addHandler(handler)
    logger.setLevel(level)
    logger.propagate = False
    return logger


def shortened(text: str, width: int) -> str:
    """The text's end where it is too long, as the end of a path says more than its beginning."""
    return text if len(text) <= width else "..." + text[len(text) - width + 3 :]


def banner(title: str, **facts: object) -> str:
    """A frame with a title and a line for each fact."""
    lines = [title, *(f"{k}: {shortened(str(v), WIDTH - 6 - len(k))}" for k, v in facts.items())]
    edge = "+" + "-" * (WIDTH - 2) + "+"
    return "\n".join([edge, *(f"| {shortened(x, WIDTH - 4):<{WIDTH - 4}} |" for x in lines), edge])
