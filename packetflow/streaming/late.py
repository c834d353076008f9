"""Rows that came too late for a stream."""

from __future__ import annotations

from collections import Counter

from pyspark.sql.streaming.listener import StreamingQueryListener


class LateRows(StreamingQueryListener):
    """Counts the rows each query has dropped because they came after the watermark, from its start on.

    Register it before the query starts: ``spark.streams.addListener(late := LateRows())``; ``late.of(query)`` then
    tells the number so far.  A query's own ``recentProgress`` forgets all but its last batches.
    """

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.dropped[str(event.progress.runId)] += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query) -> int:
        return self.dropped[str(query.runId)]
