"""Records and receipts to files. Tables are written by Spark's committer; receipts of one row by the driver."""

from __future__ import annotations

import contextlib
import json
import math
import os
import sys
import time
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from typing import Any, TextIO

from pyspark.sql import DataFrame

from ..errors import ConfigError


def sink_records(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines, in a folder of parts; a task that fails leaves nothing behind."""
    df.write.mode(mode).json(path)


def sink_append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _plain(x: Any) -> Any:
    """Numbers that JSON lacks as strings."""
    if isinstance(x, float) and not math.isfinite(x):
        return str(x)
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def sink_report(df: DataFrame, path: str) -> dict:
    """A report of one row as a JSON file, replaced as a whole."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ConfigError("a report has one row")
    value = _plain(rows[0].asDict(True))
    write_json(path, value)
    return value


def write_json(path: str, value: Any) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    with part.open("w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    part.replace(target)


class RunLog:
    """A run's folder on the driver: stamps, a log of metrics that is only appended to, what was said, and sinks of one's own.

    Each of `sinks` is called with every row that is logged, as it is written.
    """

    def __init__(self, folder: str, resume: bool = False, sinks: Sequence[Callable[[dict], None]] = (), console: TextIO | None = None):
        self.folder = Path(folder)
        if self.folder.exists() and any(self.folder.iterdir()) and not resume:
            raise ConfigError(f"{folder} holds a run already")
        self.folder.mkdir(parents=True, exist_ok=True)
        self.began, self.sinks, self.console, self.not_finite = time.monotonic(), list(sinks), console, 0

    def stamp(self, name: str, value: dict) -> None:
        write_json(str(self.folder / f"{name}.json"), _plain(value))

    def log(self, step: int | None, echo: bool = False, **metrics: float) -> None:
        row = {"step": step, "t": time.monotonic() - self.began, **_plain(metrics)}
        self.not_finite += sum(isinstance(v, float) and not math.isfinite(v) for v in metrics.values())
        for sink in self.sinks:
            sink(row)
        self._append("metrics.jsonl", json.dumps(row))
        if echo:
            self.say(" ".join(f"{k}={v}" for k, v in row.items() if k != "t" and v is not None))

    def say(self, text: str) -> None:
        print(text, file=self.console or sys.stdout)
        self._append("console.log", text)

    @contextlib.contextmanager
    def timer(self, name: str) -> Iterator[None]:
        """Logs the seconds of a block, also if it fails."""
        began = time.monotonic()
        try:
            yield
        finally:
            self.log(None, **{f"seconds/{name}": time.monotonic() - began})

    def _append(self, name: str, line: str) -> None:
        with (self.folder / name).open("a", encoding="utf-8") as f:
            f.write(line + "\n")
            f.flush()
            os.fsync(f.fileno())
