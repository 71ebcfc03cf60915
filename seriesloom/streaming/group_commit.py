"""Group commit: batches of several threads share one durable commit."""

from __future__ import annotations

import queue
import threading
import time
from concurrent.futures import Future
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.plans.engine import Engine

#: Positions of one batch within its commit.
SPAN = 1 << 40


class GroupCommit:
    """Takes batches from any thread, commits up to ``max_batch`` of them at once, and gives each its sequence.

    A full queue (``capacity``) blocks callers. The worker takes what is there, waits ``delay`` seconds for more, and commits; within
    a commit later batches win, then commit_pos (below 2 ** 40), then the value. If a commit fails, each of its callers gets the error.
    """

    def __init__(self, engine: Engine, max_batch: int = 256, delay: float = 0.0, capacity: int = 1024):
        self.engine, self.max_batch, self.delay = engine, max_batch, delay
        self._queue: queue.Queue = queue.Queue(capacity)
        self._worker = threading.Thread(target=self._run, daemon=True)
        self._worker.start()

    def submit(self, points: DataFrame) -> Future:
        """A future of the batch's sequence; it is durable when the future is done."""
        done: Future = Future()
        self._queue.put((points, done))
        return done

    def append(self, points: DataFrame) -> int:
        return self.submit(points).result()

    def drain(self) -> int:
        """Waits until everything submitted before is committed, and returns the current sequence."""
        done: Future = Future()
        self._queue.put((None, done))
        return done.result()

    def current_sequence(self) -> int:
        return self.engine.current_sequence()

    def close(self) -> None:
        self.drain()
        self._queue.put(None)
        self._worker.join()

    def _run(self) -> None:
        while (first := self._queue.get()) is not None:
            group, last = [first], False
            if self.delay:
                time.sleep(self.delay)
            while len(group) < self.max_batch:
                try:
                    item = self._queue.get_nowait()
                except queue.Empty:
                    break
                if item is None:
                    last = True
                    break
                group.append(item)
            self._commit(group)
            if last:
                return

    def _commit(self, group: list[tuple[DataFrame | None, Future]]) -> None:
        batches = [points for points, _ in group if points is not None]
        try:
            seq = self.engine.append(self._joined(batches)) if batches else 0
        except Exception as e:
            for _, done in group:
                done.set_exception(e)
            return
        for points, done in group:
            done.set_result(seq if points is not None else self.engine.current_sequence())

    def _joined(self, batches: list[DataFrame]) -> DataFrame:
        """One batch of several, with no more tasks and files than cores: each brings partitions of its own, mostly small ones."""
        rows = reduce(DataFrame.unionByName, [self._placed(p, i) for i, p in enumerate(batches)])
        return rows.coalesce(self.engine.spark.sparkContext.defaultParallelism) if len(batches) > 1 else rows

    @staticmethod
    def _placed(points: DataFrame, nth: int) -> DataFrame:
        pos = F.col("commit_pos") if "commit_pos" in points.columns else F.lit(0)
        return points.select("metric_name", "tags", "timestamp_ns", "value", (pos.cast("long") + nth * SPAN).alias("commit_pos"))
