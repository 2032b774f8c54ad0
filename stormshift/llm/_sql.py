"""SQL text that the operators' twins share."""

from __future__ import annotations


def crc32_table() -> str:
    """A step `crc_table`: the 256 remainders of the reflected polynomial, as one list t."""
    step = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END"
    return f"crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(range(8), {step}, b)) AS t)"


def crc32_text(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8, for code points below 2048; reads t of `crc_table`."""
    octets = f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN x = '' THEN [] WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 + ord(x) // 64 AS BIGINT), CAST(128 + ord(x) % 64 AS BIGINT)] END))"
    return f"xor(CAST(4294967295 AS BIGINT), list_reduce({octets}, lambda c, o: xor(c >> 8, t[(xor(c, o) & 255) + 1]), CAST(4294967295 AS BIGINT)))"
