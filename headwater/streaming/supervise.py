"""Several independent streams in one session: one that fails is reported, the others go on."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

REPORT = "name string, state string, batches long, rows long, error string"


@dataclass
class _Record:
    batches: set[int] = field(default_factory=set)
    rows: int = 0
    ended: bool = False
    error: str | None = None


class _Recorder(StreamingQueryListener):
    """What each run has done so far; a few numbers a stream."""

    def __init__(self):
        self.runs: dict[str, _Record] = {}
        self.lock = threading.Condition()

    def _of(self, run: object) -> _Record:
        return self.runs.setdefault(str(run), _Record())

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self._of(event.runId)

    def onQueryProgress(self, event) -> None:
        with self.lock:
            record = self._of(event.progress.runId)
            if event.progress.batchId not in record.batches:
                record.batches.add(event.progress.batchId)
                record.rows += event.progress.numInputRows or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            record = self._of(event.runId)
            record.ended, record.error = True, event.exception
            self.lock.notify_all()


def run_streams(spark: SparkSession, starts: dict[str, Callable[[], StreamingQuery]], seconds: float = 3600) -> DataFrame:
    """Starts all streams, waits until each has ended, and returns (name, state, batches, rows, error) for each.

    state is done, failed (the stream threw), not started (its start threw) or stopped (it still ran after ``seconds``).
    No stream waits for another, and a failure ends its own stream alone. error is the first line of the cause.
    """
    recorder = _Recorder()
    spark.streams.addListener(recorder)
    running: dict[str, StreamingQuery] = {}
    out: dict[str, tuple] = {}
    try:
        for name, start in starts.items():
            try:
                running[name] = start()
            except Exception as error:  # noqa: BLE001  the others must start whatever this one does
                out[name] = (name, "not started", 0, 0, str(error).split("\n")[0])
        runs = {name: str(query.runId) for name, query in running.items()}
        with recorder.lock:
            ended = recorder.lock.wait_for(lambda: all(recorder.runs.get(r, _Record()).ended for r in runs.values()), seconds)
        for name, query in running.items():
            record = recorder.runs.get(runs[name], _Record())
            if not record.ended and not ended:
                query.stop()
            state = "failed" if record.error else "done" if record.ended else "stopped"
            out[name] = (name, state, len(record.batches), record.rows, record.error.split("\n")[0] if record.error else None)
    finally:
        spark.streams.removeListener(recorder)
    return spark.createDataFrame([out[name] for name in starts], REPORT)
