"""One JSON object per log line: timestamp, level, event, and the fields of the event."""

from __future__ import annotations

import json
import logging
import sys
from datetime import datetime, timezone
from typing import Any

_logger = logging.getLogger("lakesmith")


class _Lines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, timezone.utc).isoformat()
        return json.dumps({"timestamp": at, "level": record.levelname, "event": record.getMessage(), **getattr(record, "fields", {})}, default=str)


def log(event: str, level: int = logging.INFO, **fields: Any) -> None:
    if not _logger.handlers:
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(_Lines())
        _logger.addHandler(handler)
        _logger.setLevel(logging.INFO)
        _logger.propagate = False
    _logger.log(level, event, extra={"fields": fields})
