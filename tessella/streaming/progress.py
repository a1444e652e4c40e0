"""What a running stream does, sampled batch by batch: the place of a separate monitor thread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Hands on one line for each batch of each stream while it is open: use it in a with statement.

    A line has batch, rows, rows_per_second and seconds. The lines so far, at most `keep` of the latest, are in `lines`.
    """

    def __init__(self, spark: SparkSession, tell: Callable[[dict], None] = lambda line: None, keep: int = 1000) -> None:
        self.spark, self.tell, self.keep = spark, tell, keep
        self.lines: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        line = {"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "seconds": p.batchDuration / 1000}
        self.lines = [*self.lines, line][-self.keep :]
        self.tell(line)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def __enter__(self) -> Progress:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.spark.streams.removeListener(self)
