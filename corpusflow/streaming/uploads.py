"""Completing uploads from parts that arrive in any order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusflow.operators.uploads import MAX_TOTAL_BYTES, PDF_HEAD, TTL_HOURS, validate_parts
from corpusflow.streaming.run import use_state_store

DONE = (
    "upload_id string, filename string, user_id string, total_parts bigint,"
    " total_bytes bigint, status string, data binary"
)


class UploadCollector(StatefulProcessor):
    """Keeps the valid parts of an upload (at most 32) until all have arrived.

    Of a part sent again the earliest by ``created_at`` counts, in whatever order they arrive (of equal times the
    lesser bytes); once an upload is handed on, its retries are ignored. The timer forgets parts and retries of an
    upload that is silent longer than the limit.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState(
            "parts", "part_index int", "at bigint, total_parts bigint, filename string, data binary"
        )
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        done = self.done.exists()
        # Every call on the state is a round trip, so each part is read and written once.
        stored = {} if done else {place[0]: tuple(value) for place, value in self.parts.iterator()}
        have, newest = dict(stored), None
        for part in rows:
            for row in part.itertuples(index=False):
                newest = row.created_at if newest is None else max(newest, row.created_at)
                at = pd.Timestamp(row.created_at).value // 1000
                sent = (at, int(row.total_parts), row.filename, bytes(row.data))
                old = have.get(int(row.part_index))
                if not done and (old is None or (sent[0], sent[3]) < (old[0], bytes(old[3]))):
                    have[int(row.part_index)] = sent
        total = max((p[1] for p in have.values()), default=0)
        if total and len(have) >= total:
            size = sum(len(p[3]) for p in have.values())
            whole = b"".join(bytes(have[place][3]) for place in sorted(have)) if size <= MAX_TOTAL_BYTES else b""
            status = (
                "too_large" if size > MAX_TOTAL_BYTES
                else "complete" if whole.startswith(PDF_HEAD.encode()) else "not_pdf"
            )
            if stored:
                self.parts.clear()
            self.done.update((True,))
            yield pd.DataFrame(
                {
                    "upload_id": [key[0]], "filename": [min(p[2] for p in have.values())], "user_id": [key[1]],
                    "total_parts": [total], "total_bytes": [size], "status": [status],
                    "data": [whole if status == "complete" else None],
                }
            )
        else:
            for place, sent in have.items():
                if stored.get(place) is not sent:
                    self.parts.updateValue((place,), sent)
        if stored or done:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
        if newest is not None:
            self.handle.registerTimer(int(pd.Timestamp(newest).timestamp() * 1000) + TTL_HOURS * 3_600_000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.parts.clear()
        self.done.clear()
        yield from ()

    def close(self) -> None:
        pass


def complete_uploads_stream(parts: DataFrame) -> DataFrame:
    """Finished uploads from a stream of parts; of a part sent again the earliest counts, as in ``upload_status``."""
    use_state_store(parts.sparkSession)
    valid = validate_parts(parts).filter("reason IS NULL").drop("reason")
    return (
        valid.withWatermark("created_at", f"{TTL_HOURS} hours")
        .groupBy("upload_id", "user_id")
        .transformWithStateInPandas(
            statefulProcessor=UploadCollector(),
            outputStructType=DONE,
            outputMode="append",
            timeMode="eventTime",
        )
    )
