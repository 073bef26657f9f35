"""Counters of running streams, read while they run."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ARRIVED = "arrived"
COUNTERS = "run STRING, batches LONG, rows LONG, running BOOLEAN, error STRING"


def counted(rows: DataFrame) -> DataFrame:
    """The same stream, with the number of its rows observed in every batch."""
    return rows.observe(ARRIVED, F.count(F.lit(1)).alias("rows"))


class RunCounters(StreamingQueryListener):
    """Totals of every stream of the session that `counted` observes, by run; safe to read at any time.

    A batch that is repeated after a failure counts once for each run that finished it.
    """

    def __init__(self):
        self._lock = threading.Lock()
        self._runs: dict[str, dict] = {}

    def _of(self, run) -> dict:
        return self._runs.setdefault(str(run), {"batches": {}, "running": True, "error": None})

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._of(event.runId)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(ARRIVED)
        if seen is not None:
            with self._lock:
                self._of(progress.runId)["batches"][progress.batchId] = seen["rows"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._of(event.runId).update(running=False, error=event.exception)

    def totals(self) -> dict[str, tuple[int, int, bool, str | None]]:
        """{run: (batches, rows, running, error)}."""
        with self._lock:
            return {run: (len(r["batches"]), sum(r["batches"].values()), r["running"], r["error"]) for run, r in self._runs.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """(`run`, `batches`, `rows`, `running`, `error`), one row per run."""
        return spark.createDataFrame([(run, *values) for run, values in sorted(self.totals().items())], COUNTERS)
