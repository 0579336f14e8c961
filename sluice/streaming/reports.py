"""Per-batch reports of running streams as rows: a listener keeps every progress update until its query has ended.

``recentProgress`` forgets old micro-batches; a listener sees them all, also while the query runs.
"""

from __future__ import annotations

from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..operators.scan import SCAN_METRICS
from ..sources.sinks import LATENCY

SCAN_REPORT = "batch bigint, records bigint, kept bigint, removed bigint, bytes_read bigint, bytes_sent bigint"
LATENCY_REPORT = "batch bigint, rows bigint, mean_ms double, max_ms bigint"
BATCH_REPORT = "batch bigint, input_rows bigint, dropped_rows bigint"
WAIT_SECONDS = 60


class BatchReports(StreamingQueryListener):
    """The progress updates of the queries of a session, by run."""

    def __init__(self):
        self.updates, self.ended = {}, {}

    def of(self, run: str) -> Event:
        return self.ended.setdefault(run, Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.updates.setdefault(str(event.progress.runId), []).append(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.of(str(event.runId)).set()


def run_reported(spark: SparkSession, writer: DataStreamWriter) -> list:
    """Runs a query over all input that is there; the updates of all its micro-batches, in order."""
    reports = BatchReports()
    spark.streams.addListener(reports)
    try:
        query = writer.trigger(availableNow=True).start()
        run = str(query.runId)
        query.awaitTermination()
        if not reports.of(run).wait(WAIT_SECONDS):  # updates come in order and the end comes last
            raise TimeoutError("the end of the query was not reported")
    finally:
        spark.streams.removeListener(reports)
    return reports.updates.get(run, [])


def _observed(updates: list, name: str, count: str) -> list[dict]:
    seen = [(u.batchId, u.observedMetrics.get(name)) for u in updates]
    return [{"batch": batch, **row.asDict()} for batch, row in seen if row is not None and row[count]]


def scan_reports(spark: SparkSession, updates: list) -> DataFrame:
    """Totals of an ``observed_scan``, a row per micro-batch with records."""
    return _frame(spark, _observed(updates, SCAN_METRICS, "records"), SCAN_REPORT)


def latency_reports(spark: SparkSession, updates: list) -> DataFrame:
    """Rows and their ages behind ``with_latency``, a row per micro-batch with rows."""
    return _frame(spark, _observed(updates, LATENCY, "rows"), LATENCY_REPORT)


def batch_reports(spark: SparkSession, updates: list) -> DataFrame:
    """Input rows and rows that lay behind the watermark, a row per micro-batch."""
    return _frame(spark, [{
        "batch": u.batchId, "input_rows": u.numInputRows,
        "dropped_rows": sum(op.numRowsDroppedByWatermark for op in u.stateOperators)} for u in updates], BATCH_REPORT)


def _frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(row[n] for n in names) for row in rows], schema)
