"""SQL expressions for DuckDB of hashes that it has no functions for, written out by their public definitions."""

from __future__ import annotations

#: The polynomial of CRC32 and the primes of XXH64.
POLYNOMIAL = 3988292384
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261

#: A common table expression with the CRC32 of every byte; queries with ``crc32`` need it.
CRC_TABLE = f"crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, {POLYNOMIAL}) ELSE c // 2 END, i)) AS t)"


def bytes_of(text: str) -> str:
    """The UTF-8 bytes of a text as a list of numbers."""
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"


def crc32(text: str, table: str = "(SELECT t FROM crc_table)") -> str:
    """CRC32 as an unsigned number; ``table`` is the list of ``CRC_TABLE``, best as a column that was joined in."""
    return f"xor(list_reduce({bytes_of(text)}, lambda c, b: xor(c // 256, {table}[xor(c % 256, b) + 1]), 4294967295), 4294967295)"


def _n(x: int) -> str:
    return f"{x}::UHUGEINT"


def _wrap(x: str) -> str:
    return f"(({x}) % {_n(1 << 64)})"


def _mul(x: str, y: int) -> str:
    return _wrap(f"({x}) * {_n(y)}")


def _turn(x: str, bits: int) -> str:
    return f"({_wrap(f'({x}) * {_n(1 << bits)}')} + ({x}) // {_n(1 << 64 - bits)})"


def _lane(x: str) -> str:
    return _mul(_turn(_mul(x, P2), 31), P1)


def _number(at: str, size: int) -> str:
    """The little-endian number of ``size`` bytes from index ``at`` (from 0) of the list b."""
    return " + ".join(f"b[{at} + {j + 1}]::UHUGEINT * {_n(1 << 8 * j)}" for j in range(size))


def xxh64(source: str, key: str) -> str:
    """A query (key, h): XXH64 with seed 0, as UHUGEINT, of column ``key`` of the table expression ``source``."""
    starts = [P1 + P2, P2, 0, -P1]
    round_ = lambda v, x: _mul(_turn(_wrap(f"{v} + {_mul(x, P2)}"), 31), P1)
    lanes = [f"list_reduce(list_transform(range(0, n // 32), lambda i: {_number(f'i * 32 + {8 * c}', 8)}), lambda v, x: {round_('v', 'x')}, {_n(s % (1 << 64))}) AS v{c}" for c, s in enumerate(starts)]
    merged = "m"
    for c in range(4):
        merged = f"(SELECT * REPLACE ({_wrap(f'{_mul(f"xor(h, {_lane(f"v{c}")})", P1)} + {_n(P4)}')} AS h) FROM {merged})"
    by8 = f"list_reduce(list_transform(range(0, (n % 32) // 8), lambda i: {_number('(n // 32) * 32 + i * 8', 8)}), lambda h, x: {_wrap(f'{_mul(_turn(f"xor(h, {_lane("x")})", 27), P1)} + {_n(P4)}')}, h)"
    by4 = f"list_reduce(list_transform(range(0, (n % 8) // 4), lambda i: {_number('(n // 8) * 8', 4)}), lambda h, x: {_wrap(f'{_mul(_turn(f"xor(h, {_mul("x", P1)})", 23), P2)} + {_n(P3)}')}, h)"
    by1 = f"list_reduce(list_transform(range(0, n % 4), lambda i: {_number('(n // 4) * 4 + i', 1)}), lambda h, x: {_mul(_turn(f'xor(h, {_mul("x", P5)})', 11), P1)}, h)"
    out = f"""(SELECT {key}, b, n, v0, v1, v2, v3, {_wrap(f"{_turn('v0', 1)} + {_turn('v1', 7)} + {_turn('v2', 12)} + {_turn('v3', 18)}")} AS h FROM
  (SELECT {key}, b, n, {", ".join(lanes)} FROM (SELECT {key}, b, len(b) AS n FROM (SELECT {key}, {bytes_of(key)} AS b FROM {source}))))"""
    out = merged.replace("FROM m)", f"FROM {out})")
    out = f"(SELECT {key}, b, n, {_wrap(f'CASE WHEN n >= 32 THEN h ELSE {_n(P5)} END + n::UHUGEINT')} AS h FROM {out})"
    for step in (by8, by4, by1):
        out = f"(SELECT * REPLACE ({step} AS h) FROM {out})"
    for shift, prime in ((33, P2), (29, P3), (32, 1)):
        out = f"(SELECT * REPLACE ({_mul(f'xor(h, h // {_n(1 << shift)})', prime)} AS h) FROM {out})"
    return f"(SELECT {key}, h FROM {out})"
