"""Log file with levels and rotation."""

from __future__ import annotations

import logging
from logging.handlers import RotatingFileHandler
from pathlib import Path

ROTATE_BYTES = 10 * 1024 * 1024


def open_log(path: str, level: str = "INFO", echo: bool = False) -> logging.Logger:
    """A logger that appends `[time] [LEVEL] text` lines to `path` and moves it to `path`.1 at 10 MB."""
    log = logging.getLogger(f"corpusloom:{path}")
    log.setLevel(level)
    log.propagate = False
    if not log.handlers:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        lines = logging.Formatter("[%(asctime)s.%(msecs)03d] [%(levelname)s] %(message)s", "%Y-%m-%d %H:%M:%S")
        for handler in (RotatingFileHandler(path, maxBytes=ROTATE_BYTES, backupCount=1, encoding="utf-8"), *([logging.StreamHandler()] if echo else [])):
            handler.setFormatter(lines)
            log.addHandler(handler)
    return log


def close_log(log: logging.Logger) -> None:
    for handler in log.handlers[:]:
        handler.close()
        log.removeHandler(handler)
