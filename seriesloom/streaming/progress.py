"""Progress of streams as counters and histograms, in the text format that scrapers read."""

from __future__ import annotations

from collections import Counter

from pyspark.sql.streaming import StreamingQueryListener

from seriesloom.functions.metrics import FLUSH_BUCKETS


class Progress(StreamingQueryListener):
    """Counts batches, rows read and the seconds of a batch; its size does not grow with the stream.

    Rows count each time that a batch's source is read: the sort by range reads it once more for its sample.
    """

    def __init__(self, bounds: list[float] | None = None):
        self.bounds = bounds or FLUSH_BUCKETS
        self.totals: Counter = Counter()
        self.within: Counter = Counter()

    def record(self, rows: int, seconds: float) -> None:
        self.totals.update(batches=1, rows=rows, seconds=seconds)
        self.within.update(b for b in self.bounds if seconds <= b)

    def onQueryStarted(self, event) -> None:
        self.totals.update(started=1)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.record(p.numInputRows, p.durationMs.get("triggerExecution", 0) / 1000)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.totals.update(failed=1) if event.exception else self.totals.update(ended=1)

    def text(self) -> str:
        """Counters and the cumulative histogram of batch seconds."""
        t = self.totals
        lines = [f"seriesloom_ingest_{k}_total {t[k]}" for k in ("batches", "rows", "failed")]
        lines += [f'seriesloom_batch_seconds_bucket{{le="{b:g}"}} {self.within[b]}' for b in self.bounds]
        lines += [f'seriesloom_batch_seconds_bucket{{le="+Inf"}} {t["batches"]}', f"seriesloom_batch_seconds_sum {t['seconds']:g}", f"seriesloom_batch_seconds_count {t['batches']}"]
        return "\n".join(lines) + "\n"
