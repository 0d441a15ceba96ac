"""Calls to a judge's server: paced, tried again where that can help, and ended after many failures in a row.

A Caller belongs to one task; what it sends goes through `post`, so tests and other protocols put their own in its place.
"""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

#: post(payload) gives a status (None: no connection) and a body.
Post = Callable[[dict], tuple[int | None, str]]


class Answer(NamedTuple):
    raw: str | None
    error: str | None
    attempts: int


@dataclass(frozen=True)
class Rules:
    #: Calls after the first, for statuses that may pass.
    retries: int = 4
    passing: tuple = (None, 408, 409, 425, 429, 500, 502, 503, 504)
    #: Seconds between the beginnings of two calls, and the longest wait before a repeated one.
    interval: float = 0.0
    longest: float = 60.0
    #: Parameters that are left out, from then on, if a server refuses them by name (status 400).
    optional: tuple = ("temperature", "seed", "response_format")
    #: Texts that fail in a row, after which no more calls are made.
    failures: int = 20


class Starts:
    """Start times on a grid that is laid from the first call on: no two calls share a cell, and a late one begins in its own."""

    def __init__(self, interval: float):
        self.interval = interval
        self._taken: tuple[float, int] | None = None

    def wait(self, now: float) -> float:
        """Seconds from now to the start that this call is given."""
        if self.interval <= 0:
            return 0.0
        if self._taken is None:
            self._taken = (now, 0)
            return 0.0
        origin, cell = self._taken
        start = max(origin + (cell + 1) * self.interval, now)
        # a call that comes late moves the grid to its own start
        self._taken = (origin, cell + 1) if start > now else (now, 0)
        return start - now


#: What becomes of a call, by status; statuses that are in no table give up.
ANSWERED, REPEAT, LEAVE_OUT, GIVE_UP = "answered", "repeat", "leave out", "give up"


@dataclass
class Caller:
    post: Post
    parameters: dict = field(default_factory=dict)
    rules: Rules = Rules()
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    jitter: Callable[[], float] = random.random
    refused: list[str] = field(default_factory=list)
    failed: int = 0

    def __post_init__(self) -> None:
        self._starts = Starts(self.rules.interval)
        self._actions = dict.fromkeys(self.rules.passing, REPEAT) | {200: ANSWERED, 400: LEAVE_OUT}

    def _delays(self) -> Iterator[float]:
        """Waits before the second call, the third and so on, as many as there may be."""
        for k in range(1, self.rules.retries + 1):
            yield min(self.rules.longest, 2.0**k) + self.jitter()

    def _post(self, text: str) -> tuple[int | None, str]:
        if wait := self._starts.wait(self.clock()):
            self.sleep(wait)
        kept = {k: v for k, v in self.parameters.items() if k not in self.refused}
        try:
            return self.post({"text": text, **kept})
        except OSError as e:
            return None, str(e)

    def _refuses(self, body: str) -> bool:
        """Whether the reply names a parameter that was sent and may be left out; then it is, from now on."""
        named = next((k for k in self.rules.optional if k in self.parameters and k not in self.refused and k in body), None)
        self.refused += [named] if named else []
        return named is not None

    def ask(self, text: str) -> Answer:
        delays = self._delays()
        for attempt in itertools.count(1):
            status, body = self._post(text)
            # a call without a refused parameter is the same attempt
            while self._actions.get(status) == LEAVE_OUT and self._refuses(body):
                status, body = self._post(text)
            action = self._actions.get(status, GIVE_UP)
            if action == ANSWERED:
                return Answer(body, None, attempt)
            delay = next(delays, None) if action == REPEAT else None
            if delay is None:
                return Answer(None, f"status {status} in call {attempt}", attempt)
            self.sleep(delay)
        raise AssertionError("attempts never end")

    def __call__(self, texts: list[str]) -> list[Answer]:
        out = []
        for text in texts:
            if self.failed < self.rules.failures:
                out.append(self.ask(text))
                self.failed = self.failed + 1 if out[-1].error else 0
            else:
                out.append(Answer(None, f"not called after {self.failed} failures in a row", 0))
        return out
