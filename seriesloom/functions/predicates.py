"""Value predicates: on rows, and on a chunk's statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ValuePredicate:
    """``gt`` and ``lt`` are strict, ``between`` holds both ends. NaN satisfies none of them."""

    kind: str
    low: float
    high: float | None = None

    @classmethod
    def gt(cls, threshold: float) -> ValuePredicate:
        return cls("gt", threshold)

    @classmethod
    def lt(cls, threshold: float) -> ValuePredicate:
        return cls("lt", threshold)

    @classmethod
    def between(cls, low: float, high: float) -> ValuePredicate:
        return cls("between", low, high)

    def row(self, value: Column) -> Column:
        hit = {"gt": lambda: value > self.low, "lt": lambda: value < self.low, "between": lambda: value.between(self.low, self.high)}[self.kind]()
        return hit & ~F.isnan(value)

    def chunk(self, least: Column, most: Column) -> Column:
        """Whether a chunk may hold such a value; without statistics it may."""
        may = {"gt": lambda: most > self.low, "lt": lambda: least < self.low, "between": lambda: (least <= self.high) & (most >= self.low)}[self.kind]()
        return F.coalesce(may, F.lit(True))


def within(ts: Column, start: int | None, end: int | None) -> Column:
    """The inclusive time range; an open side has no conjunct."""
    out = F.lit(True)
    if start is not None:
        out = out & (ts >= start)
    if end is not None:
        out = out & (ts <= end)
    return out


def has_tags(tags: Column, wanted: dict[str, str]) -> Column:
    """Whether a tag map holds all of these pairs; no pairs fit every map."""
    out = F.lit(True)
    for k, v in sorted(wanted.items()):
        out = out & F.coalesce(F.try_element_at(tags, F.lit(k)) == v, F.lit(False))
    return out
