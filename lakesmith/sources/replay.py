"""A paged source in memory that behaves like a live one: batches that become visible, throttling and failures.

It stands in for a service when a pipeline is rehearsed or tested; a `Pager` reads it like any other transport.
"""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from lakesmith.sources.pager import Response, page_bounds, pages_of


def visible_fields(record: dict[str, Any]) -> dict[str, Any]:
    """A record without its private fields, whose names begin with an underscore."""
    return {k: v for k, v in record.items() if not k.startswith("_")}


@dataclass
class Replay:
    """Serves the records of the batches made visible so far, in order of (updated_at, event_id).

    At most `per_second` answers are given within any second, beyond that 429; of the rest a share `flaky` is 503, drawn
    from `seed`. Pages after the first repeat the last `overlap` records of the page before.
    """

    batches: Sequence[Sequence[dict[str, Any]]]
    per_second: int = 10
    flaky: float = 0.0
    overlap: int = 0
    seed: int = 0
    clock: Callable[[], float] = time.monotonic
    _batch: int = 1
    _answered: deque[float] = field(default_factory=deque)
    _random: random.Random | None = None

    def health(self) -> dict[str, Any]:
        return {"status": "ok", **self.state(), "records": sum(map(len, self.batches))}

    def state(self) -> dict[str, int]:
        """The batch that is visible last, and how many records can be seen."""
        return {"batch": self._batch, "visible": sum(map(len, self.batches[: self._batch]))}

    def advance(self) -> dict[str, int]:
        """Makes the next batch visible, if there is one."""
        self._batch = min(self._batch + 1, max(1, len(self.batches)))
        return self.state()

    def reset(self) -> dict[str, int]:
        """Back to the first batch."""
        self._batch = 1
        return self.state()

    def __call__(self, params: dict[str, Any]) -> Response:
        now = self.clock()
        while self._answered and self._answered[0] <= now - 1:
            self._answered.popleft()
        if len(self._answered) >= self.per_second:
            return Response(429, headers={"Retry-After": "1"})
        self._answered.append(now)
        self._random = self._random or random.Random(self.seed)
        if self._random.random() < self.flaky:
            return Response(503)
        seen = (r for batch in self.batches[: self._batch] for r in batch)
        rows = sorted((r for r in seen if r.get("updated_at", "") >= params["since"]), key=lambda r: (r.get("updated_at", ""), r.get("event_id") or ""))
        start, stop = page_bounds(params["page"], params["page_size"], self.overlap)
        return Response(200, {"data": [visible_fields(r) for r in rows[start:stop]], "total_pages": pages_of(len(rows), params["page_size"])})
