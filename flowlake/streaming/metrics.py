"""Counters of running streams, for whatever collects them."""

from __future__ import annotations

import threading

from pyspark.sql.streaming import StreamingQueryListener

COUNTERS = ("streams_started", "streams_ended", "streams_failed", "batches", "rows_in", "state_rows", "late_rows_dropped")


class StreamMetrics(StreamingQueryListener):
    """spark.streams.addListener(StreamMetrics()): counts over all streams of the session; state_rows is of the latest batch of each."""

    def __init__(self):
        self._counts, self._state, self._lock = dict.fromkeys(COUNTERS, 0), {}, threading.Lock()

    def _add(self, **more: int) -> None:
        with self._lock:
            for k, n in more.items():
                self._counts[k] += n

    def onQueryStarted(self, event) -> None:
        self._add(streams_started=1)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._add(batches=1, rows_in=max(0, p.numInputRows), late_rows_dropped=sum(s.numRowsDroppedByWatermark for s in p.stateOperators))
        with self._lock:
            self._state[str(p.runId)] = sum(s.numRowsTotal for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add(streams_ended=1, streams_failed=int(event.exception is not None))
        with self._lock:
            self._state.pop(str(event.runId), None)

    def values(self) -> dict[str, int]:
        with self._lock:
            return self._counts | {"state_rows": sum(self._state.values())}

    def prometheus(self) -> str:
        return "".join(f"# TYPE flowlake_{n} {'gauge' if n == 'state_rows' else 'counter'}\nflowlake_{n} {v}\n" for n, v in self.values().items())
