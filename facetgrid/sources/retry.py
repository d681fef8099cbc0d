"""Driver-side retries for sources over a network; pages of data never come this way."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

Got = TypeVar("Got")


class SourceError(Exception):
    def __init__(self, message: str, status: int = 0, transient: bool = False, retry_after: float = 0.0) -> None:
        super().__init__(message)
        self.status, self.transient, self.retry_after = status, transient, retry_after

    @property
    def retriable(self) -> bool:
        return self.transient or self.status == 429 or 500 <= self.status < 600


def backoff(base: float, attempt: int, cap: float = 60.0) -> float:
    return min(base * 2**attempt, cap)


def jittered(base: float, jitter: float) -> float:
    return base + random.random() * jitter


def with_retries(call: Callable[[], Got], retries: int, base: float, sleep: Callable[[float], None] = time.sleep) -> Got:
    """``retries`` + 1 tries; waits the backoff or what the server asks for, whichever is longer."""
    for attempt in range(retries + 1):
        try:
            return call()
        except SourceError as e:
            if attempt == retries or not e.retriable:
                raise
            sleep(max(backoff(base, attempt), e.retry_after))
    raise AssertionError


def fetch_pages(fetch: Callable[[int], dict], retries: int, base: float, min_total: int = 0, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """All pages or an error: the first tells how many there are."""
    first = with_retries(lambda: fetch(1), retries, base, sleep)
    if first["maxPageNo"] < 1 or first["total"] < min_total:
        raise SourceError(f"{first['total']} rows on {first['maxPageNo']} pages")
    return [first, *[with_retries(lambda n=n: fetch(n), retries, base, sleep) for n in range(2, first["maxPageNo"] + 1)]]
