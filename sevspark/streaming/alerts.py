"""'Breach must last' alerts over a stream, by keyed state with event-time timers.

Each series is a stateful processor. Samples wait in its state until the watermark has passed them, so they are judged in
order of time whatever the order of arrival; then one small record is kept, the open breach. A timer ends it when the next
sample stays away. State, timers and offsets live in the checkpoint and survive a restart; fired alerts go through the file
sink, each once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import work_path
from .runner import ROCKSDB, append_to

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NO_DATA = ("ends", "holds", "fires")


class Breach:
    """The open breach of one series while its samples come in order of time."""

    def __init__(self, step_s: int, for_s: int, no_data: str, state: tuple | None = None):
        self.step_s, self.for_s, self.no_data = step_s, for_s, no_data
        #: start and last second of the breach and whether it fired; ``start`` is None without a breach
        self.start, self.last, self.fired = state or (None, None, False)

    def _fire(self, now: int) -> list[tuple[int, int]]:
        if self.start is None or self.fired or now - self.start < self.for_s:
            return []
        self.fired = True
        return [(self.start, self.start + self.for_s)]

    def sample(self, t: int, breach: bool) -> list[tuple[int, int]]:
        """``(start, fired)`` of the alert that this sample sets off, if any."""
        out = self.silence(t) if self.last is not None and t - self.last > self.step_s else []
        if not breach:
            self.start, self.last, self.fired = None, None, False
            return out
        if self.start is None:
            self.start = t
        self.last = t
        return out + self._fire(t)

    def silence(self, now: int) -> list[tuple[int, int]]:
        """No sample within a step after the last one, up to ``now``: the rule for missing data applies."""
        if self.start is None or self.no_data == "holds":
            return []
        out = self._fire(now) if self.no_data == "fires" else []
        if self.no_data == "ends":
            self.start, self.last, self.fired = None, None, False
        return out

    def state(self) -> tuple:
        return self.start, self.last, self.fired


class Lasting(StatefulProcessor):
    """``(keys, start_s, fired_s)`` of alerts, from rows ``keys, second, tie, breach``."""

    def __init__(self, keys: Sequence[str], step_s: int, for_s: int, no_data: str):
        self.keys, self.rule = list(keys), (step_s, for_s, no_data)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, tie long, breach boolean")
        self.open = handle.getValueState("open", "start long, last long, fired boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(t), int(tie), bool(b)) for pdf in rows for t, tie, b in zip(*(pdf[c] for c in ("second", "tie", "breach")))]
        if fresh:
            self.waiting.appendList(fresh)
            self._wake(min(t for t, _, _ in fresh) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() // 1000
        held = sorted(self.waiting.get()) if self.waiting.exists() else []
        # a second is complete when the watermark has reached the next one
        due, later = [x for x in held if x[0] + 1 <= mark], [x for x in held if x[0] + 1 > mark]
        breach = Breach(*self.rule, tuple(self.open.get()) if self.open.exists() else None)
        fired = [alert for t, _, broken in due for alert in breach.sample(t, broken)]
        step_s = self.rule[0]
        if breach.start is not None and breach.last + step_s + 1 <= mark:
            fired += breach.silence(mark)
        if later:
            self.waiting.put(later)
            self._wake(later[0][0] + 1)
        else:
            self.waiting.clear()
        if breach.start is None:
            self.open.clear()
        else:
            self.open.update(breach.state())
            # wakes when a sample is missing, then at the earliest second at which it would have lasted
            wake = max(breach.last + step_s, breach.start + self.rule[1] if self.rule[2] == "fires" else 0) + 1
            if not (breach.fired and self.rule[2] != "ends") and wake > mark:
                self._wake(wake)
        if fired:
            rows = {k: [v] * len(fired) for k, v in zip(self.keys, key)}
            yield pd.DataFrame({**rows, "start_s": [a for a, _ in fired], "fired_s": [b for _, b in fired]})

    def _wake(self, second: int) -> None:
        at = second * 1000
        if at not in set(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def lasting(
    stream: DataFrame, ts: str, keys: Sequence[str], tie: str, step_s: int, for_s: int, late: str, no_data: str = "ends"
) -> DataFrame:
    """Stream of ``keys, start_s, fired_s`` from a stream of ``keys, ts, tie, breach``: breaches that last ``for_s`` seconds.

    A gap of over ``step_s`` seconds between samples is missing data: the breach ``ends``, ``holds`` until a sample decides, or
    ``fires`` when it would have lasted. Samples of one second are judged by ``tie``. Rows later than ``late`` are dropped, rows
    without a time too; a missing ``breach`` is none. An alert is given once, when the watermark has passed it. Timers need the
    state store ``runner.ROCKSDB``.
    """
    if no_data not in NO_DATA:
        raise ValueError(f"unknown rule for missing data: {no_data}")
    kinds = dict(stream.dtypes)
    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(
        *keys, ts, F.unix_timestamp(ts).alias("second"), F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("tie"), F.coalesce("breach", F.lit(False)).alias("breach")
    )
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", start_s long, fired_s long"
    return rows.groupBy(*keys).transformWithStateInPandas(Lasting(keys, step_s, for_s, no_data), schema, "Append", "EventTime")


def run_alerts(
    stream: DataFrame, ts: str, keys: Sequence[str], tie: str, step_s: int, for_s: int, late_s: int = 600,
    path: str | None = None, checkpoint: str | None = None, no_data: str = "ends",
) -> DataFrame:
    """Alerts of a stream of ``keys, ts, tie, breach``; returns the table of fired alerts.

    To go on after a restart give both ``path`` (alerts) and ``checkpoint`` (offsets, state, timers).
    """
    if (path is None) != (checkpoint is None):
        raise ValueError("path and checkpoint belong together")
    spark, store = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    fired = lasting(stream, ts, keys, tie, step_s, for_s, f"{late_s} seconds", no_data)
    before = spark.conf.get(store)
    spark.conf.set(store, ROCKSDB)
    try:
        return append_to(fired, path or work_path(spark, "alerts"), checkpoint or work_path(spark, "alerts-offsets"))
    finally:
        spark.conf.set(store, before)
