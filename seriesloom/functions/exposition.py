"""Counters, gauges and histograms of a running engine, in the text format that scrapers read."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager


class Meter:
    """Its size depends on the names and labels in use, not on how often they are counted. Safe to use from several threads."""

    def __init__(self, prefix: str = "seriesloom"):
        self.prefix = prefix
        self._lock = threading.Lock()
        self.counters: dict[str, float] = defaultdict(float)
        self.gauges: dict[str, float] = {}
        self.bounds: dict[str, list[float]] = {}
        self.seen: dict[str, list[float]] = {}  # [rows within each bound..., count, sum]

    @staticmethod
    def _named(name: str, labels: dict[str, str]) -> str:
        return name + ("{" + ",".join(f'{k}="{v}"' for k, v in sorted(labels.items())) + "}" if labels else "")

    def count(self, name: str, by: float = 1, **labels: str) -> None:
        with self._lock:
            self.counters[self._named(name, labels)] += by

    def gauge(self, name: str, value: float) -> None:
        with self._lock:
            self.gauges[name] = value

    def observe(self, name: str, value: float, bounds: list[float]) -> None:
        with self._lock:
            self.bounds.setdefault(name, bounds)
            cells = self.seen.setdefault(name, [0.0] * (len(self.bounds[name]) + 2))
            for i, b in enumerate(self.bounds[name]):
                cells[i] += value <= b
            cells[-2] += 1
            cells[-1] += value

    @contextmanager
    def timed(self, name: str, bounds: list[float]) -> Iterator[None]:
        """Observes the seconds that the block takes, and counts it as ok or error."""
        began = time.perf_counter()
        try:
            yield
        except BaseException:
            self.count(f"{name}_total", status="error")
            raise
        self.count(f"{name}_total", status="ok")
        self.observe(f"{name}_seconds", time.perf_counter() - began, bounds)

    def text(self) -> str:
        """All of them, histograms cumulative."""
        with self._lock:
            lines = [f"{self.prefix}_{k} {v:g}" for k, v in sorted({**self.counters, **self.gauges}.items())]
            for name, cells in sorted(self.seen.items()):
                at = f"{self.prefix}_{name}"
                lines += [f'{at}_bucket{{le="{b:g}"}} {n:g}' for b, n in zip(self.bounds[name], cells, strict=False)]
                lines += [f'{at}_bucket{{le="+Inf"}} {cells[-2]:g}', f"{at}_sum {cells[-1]:g}", f"{at}_count {cells[-2]:g}"]
        return "\n".join(lines) + "\n"
