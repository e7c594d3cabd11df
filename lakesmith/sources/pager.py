"""An incremental, paginated HTTP source: retries, rate limit and paging as plain Python over an injected transport."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol


@dataclass(frozen=True)
class Response:
    status: int
    body: dict[str, Any] = field(default_factory=dict)
    headers: dict[str, str] = field(default_factory=dict)


class Transport(Protocol):
    def __call__(self, params: dict[str, Any]) -> Response: ...


class Unreachable(Exception):
    """A timeout or a lost connection; the transport raises it."""


class SourceError(RuntimeError):
    """The source gave no page: its budget of retries is used up, or it answered with an error that retrying cannot mend."""


@dataclass
class Pager:
    """`records(since)` reads all pages in order. What may be retried, and how often, holds for one page at a time:

    * 429 waits as long as Retry-After says, else a backoff, at most `throttled` times;
    * 503 and lost connections share a budget of `failures`;
    * any other status from 400 on ends the run at once.
    """

    transport: Transport
    page_size: int = 500
    per_second: float = 10.0
    throttled: int = 10
    failures: int = 5
    longest: float = 30.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    jitter: Callable[[], float] = random.random
    _last: float | None = None

    def backoff(self, attempt: int) -> float:
        """2 ** attempt seconds up to `longest`, and up to a quarter more."""
        base = min(2.0**attempt, self.longest)
        return base + base * 0.25 * self.jitter()

    def _pace(self) -> None:
        if self._last is not None and (wait := self._last + 1.0 / self.per_second - self.clock()) > 0:
            self.sleep(wait)
        self._last = self.clock()

    def page(self, number: int, since: str) -> dict[str, Any]:
        throttled = failures = 0
        while True:
            self._pace()
            try:
                answer: Response | None = self.transport({"since": since, "page": number, "page_size": self.page_size})
            except Unreachable:
                answer = None
            if answer is not None and answer.status < 400:
                return answer.body
            if answer is not None and answer.status == 429:
                throttled += 1
                if throttled > self.throttled:
                    raise SourceError(f"page {number}: throttled {throttled} times")
                after = _seconds(answer.headers.get("Retry-After"))
                self.sleep(after or self.backoff(throttled - 1))
            elif answer is None or answer.status == 503:
                failures += 1
                if failures > self.failures:
                    raise SourceError(f"page {number}: failed {failures} times")
                self.sleep(self.backoff(failures - 1))
            else:
                raise SourceError(f"page {number}: status {answer.status}")

    def records(self, since: str) -> Iterator[dict[str, Any]]:
        """Every record of every page in order; overlaps of pages are passed on, the raw zone keeps each line once."""
        number, pages = 1, 1
        while number <= pages:
            body = self.page(number, since)
            pages = int(body.get("total_pages", 1))
            yield from body.get("data", [])
            number += 1


def _seconds(text: str | None) -> float | None:
    try:
        return float(text) if text is not None else None
    except ValueError:
        return None


def pages_of(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def page_bounds(number: int, size: int, overlap: int) -> tuple[int, int]:
    """First and last row (exclusive) of a page that repeats the end of the page before."""
    start = (number - 1) * size
    return (max(0, start - overlap) if number > 1 else start), number * size
