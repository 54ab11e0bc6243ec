"""Pacing of hosts that outlives a micro-batch: when each URL of a stream may be fetched.

The state of a host is the time from which on it may be asked again; it is kept from batch to batch in the state store, so
two batches of one host keep its delay.  A host that has been quiet gets up to ``burst`` URLs at once, as from a full bucket of
tokens.  In a stream that goes on, a timer drops the state of a host that has been quiet for ``idle`` seconds beyond its last slot, so state goes with the hosts that are
being crawled, not with all that ever were.  A stream that ends (``availableNow``) is to have no timers: with them, it would wait for each.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagequarry.functions import urls

SLOTS = "host string, url string, not_before timestamp, wait_s double"


class HostPace(StatefulProcessor):
    """Slots of one host, in the order of arrival (of one batch: of the URL)."""

    def __init__(self, delay: float, burst: int, idle: float | None):
        self.delay, self.burst, self.idle = delay, max(1, burst), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.free = handle.getValueState("free", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = time.time()
        # The virtual time at which the bucket is full again; a slot is that less what a burst allows.
        free = self.free.get()[0] if self.free.exists() else now
        for part in rows:
            found = []
            for url in sorted(part["url"]):
                free = max(free, now)
                at = max(now, free - (self.burst - 1) * self.delay)
                found.append((key[0], url, pd.Timestamp(round(at * 1e6), unit="us", tz="UTC"), at - now))
                free += self.delay
            # Plain objects: strings that pandas keeps in Arrow chunks don't pass to a task's output.
            yield pd.DataFrame(found, columns=["host", "url", "not_before", "wait_s"]).astype({"host": object, "url": object})
        self.free.update((free,))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((free + self.idle) * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.free.clear()
        yield pd.DataFrame({"host": pd.Series([], dtype=object), "url": pd.Series([], dtype=object), "not_before": pd.Series([], dtype="datetime64[us, UTC]"), "wait_s": pd.Series([], dtype=float)})

    def close(self) -> None:
        pass


def use_state_store(spark) -> None:
    """Keyed state with timers needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def paced(links: DataFrame, delay: float = 0.5, burst: int = 1, idle: float | None = None) -> DataFrame:
    """host, url, not_before, wait_s of a stream of (url): each host's URLs at least ``delay`` seconds apart."""
    use_state_store(links.sparkSession)
    named = links.select(urls.netloc("url").alias("host"), "url")
    return named.groupBy("host").transformWithStateInPandas(HostPace(delay, burst, idle), SLOTS, "Append", "None" if idle is None else "ProcessingTime")
