"""Expressions that several text operators share."""

from __future__ import annotations

import contextlib
import ctypes

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the white space that the operators' contracts name, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(text: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def once(df: DataFrame, copies: str, keys: list[str]) -> DataFrame:
    """Rows of ``df``, where those that share ``keys`` count once; ``copies`` says how many share them.

    Rows with one copy pass without a shuffle; only repeated rows are grouped.
    """
    return df.where(F.col(copies) == 1).unionByName(df.where(F.col(copies) > 1).dropDuplicates(keys))


def trim() -> None:
    """Gives a Python worker's free memory back to the system: workers stay alive between tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)
