"""Pieces of SQL that the queries of several operators are compared with: DuckDB has no CRC-32 of its own."""

from __future__ import annotations

#: Common table expressions (after WITH RECURSIVE): crc_table has the 256 remainders of the reflected polynomial as one list.
CRC_TABLE = """crc_steps(i, k, c) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS remainders FROM crc_steps WHERE k = 8)"""


def crc32(text: str, remainders: str = "remainders") -> str:
    """The unsigned CRC-32 of an expression's UTF-8 bytes; remainders: crc_table's column, joined to the row."""
    digits = f"hex(encode({text}))"
    each = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr({digits}, (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {each}), lambda c, b: xor(c >> 8, {remainders}[(xor(c, b) & 255) + 1])), 4294967295)"
