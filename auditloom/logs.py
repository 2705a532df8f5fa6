"""Log lines to standard error, as text or as JSON."""

from __future__ import annotations

import json
import logging
import sys
import time

log = logging.getLogger("auditloom")


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created))
        return json.dumps({"level": record.levelname.lower(), "time": at, "message": record.getMessage()}, ensure_ascii=False)


def set_up(level: str = "info", form: str = "pretty", stream=None) -> logging.Logger:
    """The package's logger with one handler; ``level`` is debug, info, warn or error, ``form`` pretty or json."""
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(_Json() if form == "json" else logging.Formatter("%(asctime)s %(levelname)-7s %(message)s", "%H:%M:%S"))
    log.handlers[:] = [handler]
    log.propagate = False
    log.setLevel({"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}[level])
    return log
