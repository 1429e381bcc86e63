"""Reconciling a stream of snapshots' rows with a table, batch by batch, with the operators of the batch engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..options import DiffOptions
from ..plans.compare import Diff, compare
from ..sources.tables import Source


def reconcile_stream(stream: DataFrame, snapshot: Callable[[], Source | DataFrame], target: Callable[[DataFrame], Source], on_diff: Callable[[Diff, int], None],
    checkpoint: str, options: DiffOptions = DiffOptions(), **trigger) -> StreamingQuery:
    """Compare each micro-batch with the snapshot as it stands then. ``on_diff`` gets the Diff and the batch's number, which lets sinks skip a batch that was done already."""

    def run(batch: DataFrame, number: int) -> None:
        on_diff(compare(batch.sparkSession, snapshot(), target(batch), options), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
