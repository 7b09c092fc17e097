"""When a user's profile is due, decided on a stream of signals."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusflow.operators.profile import REFRESH_DELTA, REFRESH_SECONDS
from corpusflow.streaming.run import use_state_store

# A user without a signal for so long is forgotten: what was pending lapses, the next signal counts as the first.
IDLE_HOURS = 24
LATE = "10 minutes"
TRIGGER = "user_id bigint, fired_at timestamp, signals bigint"


class RefreshThrottle(StatefulProcessor):
    """Fires after 3 new signals, or on a new one 60 s after the last refresh.

    Input rows are counts per user and second, so a very active user brings few
    rows. State per user is three numbers and ends with a timer ``IDLE_HOURS`` after the last signal; the
    limit itself is judged by event time, so results do not depend on when the timer fires.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "pending bigint, last_ms bigint, seen_ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pending, last, seen = self.state.get() if self.state.exists() else (0, None, None)
        # Counts of one second may come from several tasks.
        frame = _combine(pd.concat(list(rows)), signals=("signals", "sum"))
        fired: list[tuple[pd.Timestamp, int]] = []
        for row in frame.itertuples(index=False):
            now = int(pd.Timestamp(row.ts).timestamp() * 1000)
            if seen is not None and now - seen >= IDLE_HOURS * 3_600_000:
                pending, last = 0, None
            seen = now if seen is None else max(seen, now)
            pending += int(row.signals)
            if pending >= REFRESH_DELTA or last is None or now - last >= REFRESH_SECONDS * 1000:
                fired.append((row.ts, pending))
                pending, last = 0, now
        self.state.update((pending, last, seen))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(seen + IDLE_HOURS * 3_600_000)
        yield pd.DataFrame(
            {
                "user_id": [key[0]] * len(fired),
                "fired_at": [ts for ts, _ in fired],
                "signals": [n for _, n in fired],
            }
        )

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _combine(frame: pd.DataFrame, **signals: tuple[str, str]) -> pd.DataFrame:
    """One row per user and second, in time order."""
    second = frame["ts"].dt.floor("s").rename("second")
    merged = frame.groupby(["user_id", second], as_index=False).agg(ts=("ts", "min"), **signals)
    return merged.sort_values("ts", kind="stable")[["user_id", "ts", "signals"]]


def _per_second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a batch per user and second, before anything is shuffled."""
    for batch in batches:
        yield _combine(batch, signals=("ts", "size"))


def profile_triggers_stream(signals: DataFrame) -> DataFrame:
    """``signals``: user_id, ts. One row per due refresh."""
    use_state_store(signals.sparkSession)
    counted = signals.select(F.col("user_id").cast("bigint").alias("user_id"), "ts").mapInPandas(
        _per_second, "user_id bigint, ts timestamp, signals bigint"
    )
    return counted.withWatermark("ts", LATE).groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=RefreshThrottle(),
        outputStructType=TRIGGER,
        outputMode="append",
        timeMode="eventTime",
    )
