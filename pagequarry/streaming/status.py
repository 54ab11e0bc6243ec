"""Live status of streams: a listener that adds up the observed metrics of every micro-batch."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class StreamStatus(StreamingQueryListener):
    """Counts of the metrics named ``name`` over all batches of the streams it listens to (``spark.streams.addListener``).

    expected: how many rows are to come, where it is known; without it, progress is 0 until the stream ends.
    on_change is told the status after each batch and at the end.
    """

    def __init__(self, name: str = "extraction", expected: int | None = None, on_change: Callable[[dict], None] | None = None):
        self.name, self.expected, self.on_change = name, expected, on_change
        self._lock = threading.Lock()
        self._counts: dict[str, int] = {}
        self._batches, self._state = 0, "pending"

    def onQueryStarted(self, event) -> None:
        self._set("running")

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is None:
            return
        with self._lock:
            self._batches += 1
            for key, value in found.asDict().items():
                self._counts[key] = self._counts.get(key, 0) + (value or 0)
        self._told()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._set("failed" if event.exception else "completed")

    def _set(self, state: str) -> None:
        with self._lock:
            self._state = state
        self._told()

    def _told(self) -> None:
        if self.on_change:
            self.on_change(self.status())

    def status(self) -> dict:
        """state, batches, progress in percent, and the counts."""
        with self._lock:
            done = sum(self._counts.values())
            share = 100.0 if self._state == "completed" else min(99.9, 100.0 * done / self.expected) if self.expected else 0.0
            return {"state": self._state, "batches": self._batches, "progress": share, **self._counts}
