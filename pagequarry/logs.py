"""JSON lines logging: plain messages stay plain, those with a context become one JSON object a line."""

from __future__ import annotations

import json
import logging
import os
from datetime import datetime


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        context = getattr(record, "context", None)
        if not context:
            return super().format(record)
        return json.dumps({"timestamp": datetime.now().isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage(), "context": context}, ensure_ascii=False, default=str)


def logger(name: str, folder: str | None = None, level: int = logging.INFO) -> logging.LoggerAdapter:
    """``log.info(message, context={...})``; also into pagequarry_YYYYMMDD.jsonl in the folder, if there is one."""
    base = logging.getLogger(name)
    base.setLevel(level)
    folder = folder or os.environ.get("PAGEQUARRY_LOG_PATH")
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if folder:
        os.makedirs(folder, exist_ok=True)
        handlers.append(logging.FileHandler(os.path.join(folder, f"pagequarry_{datetime.now():%Y%m%d}.jsonl"), encoding="utf-8"))
    for h in list(base.handlers):
        base.removeHandler(h)
    for h in handlers:
        h.setFormatter(JsonLines("%(asctime)s %(levelname)s %(name)s %(message)s"))
        base.addHandler(h)

    class Adapter(logging.LoggerAdapter):
        def process(self, message, kwargs):
            kwargs["extra"] = {"context": kwargs.pop("context", None)}
            return message, kwargs

    return Adapter(base, {})
