"""Frames of a byte log: length and CRC32 of the payload as little-endian 32-bit numbers, then the payload."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = struct.Struct("<II")


def _little_endian(number: Column) -> Column:
    """The 32 low bits of a number as four bytes, lowest first."""
    digits = F.lpad(F.hex(number.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, 1 + 2 * i, 2) for i in (3, 2, 1, 0)]))


def frame(payload: Column) -> Column:
    """The frame of a binary payload."""
    return F.concat(_little_endian(F.octet_length(payload)), _little_endian(F.crc32(payload)), payload)


def unframed(log: bytes) -> tuple[list[bytes], bool]:
    """(payloads, whether the log is torn): reading ends at the first frame that is cut short or fails its checksum."""
    at, out = 0, []
    while at < len(log):
        if at + HEAD.size > len(log):
            return out, True
        size, crc = HEAD.unpack_from(log, at)
        payload = log[at + HEAD.size : at + HEAD.size + size]
        if len(payload) < size or zlib.crc32(payload) != crc:
            return out, True
        out.append(payload)
        at += HEAD.size + size
    return out, False


def read_frames(segments: DataFrame, name: str = "name", log: str = "log") -> DataFrame:
    """(name, pos, payload, torn): the frames of each segment, ``segments`` having one row each. A torn one ends with a row without payload."""
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payloads, torn = unframed(data or b"")
                rows = [(of, i, p, False) for i, p in enumerate(payloads)] + ([(of, len(payloads), None, True)] if torn else [])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["name", "pos", "payload", "torn"])

    return segments.select(F.col(name).alias("name"), F.col(log).alias("log")).mapInArrow(run, "name string, pos bigint, payload binary, torn boolean")
