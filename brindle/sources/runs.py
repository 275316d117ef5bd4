"""What belongs to one run: its id, folders, log and clock."""

from __future__ import annotations

import logging
import uuid
from datetime import UTC, datetime
from pathlib import Path

FOLDERS = ("raw", "assets", "artifacts", "logs")


def now_iso(now: datetime | None = None) -> str:
    """Seconds of UTC, such as 2024-05-01T10:20:30Z; the clock can be given."""
    return (now or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def run_id(now: datetime | None = None, tail: str | None = None) -> str:
    """run_<date>_<time>_<six hexadecimal digits>, in local time."""
    return f"run_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}_{tail or uuid.uuid4().hex[:6]}"


class Run:
    """Folders below root, made where they are missing, and a log file by the run's id, on the driver."""

    def __init__(self, root: str, name: str | None = None):
        self.id = name or run_id()
        self.folders = {f: Path(root) / f for f in FOLDERS}
        for path in self.folders.values():
            path.mkdir(parents=True, exist_ok=True)
        self.log = logging.getLogger(f"brindle.{self.id}")
        self.log.setLevel(logging.INFO)
        self.log.propagate = False
        if not self.log.handlers:
            to = logging.FileHandler(self.folders["logs"] / f"{self.id}.log", encoding="utf-8")
            to.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s", "%Y-%m-%dT%H:%M:%S"))
            self.log.addHandler(to)

    def close(self) -> None:
        for h in list(self.log.handlers):
            h.close()
            self.log.removeHandler(h)
