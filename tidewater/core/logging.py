"""Loggers of the library."""

from __future__ import annotations

import logging

ROOT = "tidewater"


def get_logger(name: str = "") -> logging.Logger:
    """The library's logger, or one below it."""
    return logging.getLogger(name if name.startswith(ROOT) else f"{ROOT}.{name}".rstrip("."))


def enable_logging(level: int | str = logging.INFO) -> logging.Logger:
    """Show the library's messages on standard error; calling it again only sets the level."""
    logger = logging.getLogger(ROOT)
    if not any(getattr(h, "_tidewater", False) for h in logger.handlers):
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        handler._tidewater = True
        logger.addHandler(handler)
    logger.setLevel(level)
    return logger
