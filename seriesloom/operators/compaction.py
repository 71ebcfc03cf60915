"""Size tiers of chunks, and what merging them frees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_ratio(ratio: float) -> float:
    if not ratio >= 1:
        raise ValueError("the size ratio must be at least 1")
    return ratio


def tiers(sizes: list[tuple[int, int]], threshold: int, ratio: float) -> list[list[int]]:
    """Groups of chunk ids: by size, a chunk joins while it is within ``ratio`` of its group's smallest; small groups go."""
    check_ratio(ratio)
    out: list[list[int]] = []
    least = 0
    for size, chunk in sorted((s, c) for c, s in sizes if s > 0):
        if out and size <= ratio * least:
            out[-1].append(chunk)
        else:
            out.append([chunk])
            least = size
    return [g for g in out if len(g) >= threshold]


def tier_column(sizes: Column, threshold: int, ratio: float) -> Column:
    """The same on an array of sizes, as an array of groups: a fold over the sorted array."""
    check_ratio(ratio)
    empty = F.array().cast("array<array<bigint>>")
    one = lambda x: F.array(x)

    def step(groups: Column, x: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        joins = F.coalesce(x <= F.lit(float(ratio)) * F.get(last, 0), F.lit(False))
        before = F.when(joins, F.slice(groups, 1, F.size(groups) - 1)).otherwise(groups)
        return F.concat(before, F.array(F.when(joins, F.concat(last, one(x))).otherwise(one(x))))

    grouped = F.aggregate(F.array_sort(F.filter(sizes.cast("array<bigint>"), lambda x: x > 0)), empty, step)
    return F.filter(grouped, lambda g: F.size(g) >= threshold)


def freed(merged: DataFrame) -> DataFrame:
    """(chunks_merged, bytes_freed) from one row (chunks, old_bytes, new_bytes) for each group."""
    gain = F.greatest(F.lit(0).cast("long"), F.col("old_bytes") - F.col("new_bytes"))
    return merged.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks_merged"), F.coalesce(F.sum(gain), F.lit(0)).alias("bytes_freed"))
