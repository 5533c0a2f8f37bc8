"""Completion of commands and paths, and the history of lines."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 16

# Commands that are offered, and one that is only offered once two letters are typed.
COMMANDS = ("/help", "/docs", "/chunks ", "/ingest ", "/stats", "/config", "/setup", "/reset", "/reload", "/debug", "/clear", "/exit")
LATE_COMMANDS = ("/quit",)


def commands(prefix: str) -> list[str]:
    return [c for c in COMMANDS + (LATE_COMMANDS if len(prefix) > 1 else ()) if c.startswith(prefix)]


def paths(typed: str, most: int = MOST) -> list[tuple[str, bool]]:
    """(completion, is a folder) of a path as typed: folders first, then by name; hidden names only after a dot."""
    shown, _, start = typed.rpartition("/")
    shown += "/" if "/" in typed else ""
    folder = os.path.expanduser(shown or ".")
    if not os.path.isdir(folder):
        return []
    names = [n for n in os.listdir(folder) if n.startswith(start) and (not n.startswith(".") or start.startswith("."))]
    found = [(n, os.path.isdir(os.path.join(folder, n))) for n in names]
    return [(shown + n + ("/" if is_dir else " "), is_dir) for n, is_dir in sorted(found, key=lambda x: (not x[1], x[0].encode()))[:most]]


def ranked(candidates: DataFrame, key: str, name: str = "name", is_dir: str = "is_dir", most: int = MOST) -> DataFrame:
    """Of each key the first `most` candidates: folders, then by name, with their rank."""
    by = Window.partitionBy(key).orderBy(F.desc(is_dir), name)
    return candidates.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)


class History:
    """Lines in a file, without immediate repeats."""

    def __init__(self, path: str, piece: int = 1023) -> None:
        self.path, self.lines = path, []
        if os.path.exists(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                for line in f.read().splitlines():
                    for at in range(0, len(line), piece):
                        self._push(line[at : at + piece])

    def _push(self, line: str) -> bool:
        if not line or self.lines[-1:] == [line]:
            return False
        self.lines.append(line)
        return True

    def add(self, line: str) -> None:
        if self._push(line):
            os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(line + "\n")
