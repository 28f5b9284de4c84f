"""DuckDB expressions of the exact hashes, for the equivalents of the queries."""

from __future__ import annotations

from tessera.functions.hashing import CRC64_ECMA, FNV32_OFFSET, FNV32_PRIME, FNV64_OFFSET, FNV64_PRIME, JUMP_MULTIPLIER, SIP_KEY, SIP_START

TWO64 = "18446744073709551616::HUGEINT"


def bytes_of(text: str, kind: str = "HUGEINT") -> str:
    return f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::{kind})"


def fnv64(text: str) -> str:
    return f"list_reduce({bytes_of(text)}, lambda h, x: xor((h * {FNV64_PRIME}::HUGEINT) % {TWO64}, x), {FNV64_OFFSET}::HUGEINT)"


def fnv32(text: str) -> str:
    return f"list_reduce({bytes_of(text, 'BIGINT')}, lambda h, x: xor((h * {FNV32_PRIME}) % 4294967296, x), {FNV32_OFFSET}::BIGINT)"


def crc64(text: str) -> str:
    bit = f"CASE WHEN c % 2 = 1 THEN xor(c >> 1, {CRC64_ECMA}::UBIGINT) ELSE c >> 1 END"
    one = f"list_reduce(range(0, 8)::UBIGINT[], lambda c, k: {bit}, xor(h, x))"
    return f"xor(list_reduce({bytes_of(text, 'UBIGINT')}, lambda h, x: {one}, 18446744073709551615::UBIGINT), 18446744073709551615::UBIGINT)"


def jump_walk(source: str, buckets: int) -> str:
    """Two CTEs (for WITH RECURSIVE): ``walk`` over the rows ``id, key hugeint`` of ``source``; the bucket of an id is its greatest b."""
    following = f"((key * {JUMP_MULTIPLIER}::HUGEINT + 1) % {TWO64})"
    return f"""walk AS (
  SELECT id, key, (-1)::BIGINT AS b, 0::BIGINT AS j FROM {source}
  UNION ALL
  SELECT id, {following}, j, floor((j + 1) * (2147483648.0::DOUBLE / (({following} // 8589934592)::DOUBLE + 1)))::BIGINT FROM walk WHERE j < {buckets})"""


def _turned(x: str, by: int) -> str:
    return f"((({x}) * {1 << by}::HUGEINT) % {TWO64} + ({x}) // {1 << (64 - by)}::HUGEINT)"


def _sip_round(source: str) -> str:
    """One SipHash round over the columns a, b, c, d of a query; its other columns stay."""
    first = f"SELECT * REPLACE ((a + b) % {TWO64} AS a, (c + d) % {TWO64} AS c) FROM ({source})"
    second = f"SELECT * REPLACE (xor({_turned('b', 13)}, a) AS b, xor({_turned('d', 16)}, c) AS d) FROM ({first})"
    third = f"SELECT * REPLACE (({_turned('a', 32)} + d) % {TWO64} AS a, (c + b) % {TWO64} AS c) FROM ({second})"
    fourth = f"SELECT * REPLACE (xor({_turned('d', 21)}, a) AS d, xor({_turned('b', 17)}, c) AS b) FROM ({third})"
    return f"SELECT * REPLACE ({_turned('c', 32)} AS c) FROM ({fourth})"


def siphash_short(source: str) -> str:
    """A query of ``item, h`` (HUGEINT) from one of different ``item`` texts of at most 7 bytes, which are one block."""
    k = [int.from_bytes(SIP_KEY[i : i + 8], "little") for i in (0, 8)]
    start = ", ".join(f"{v ^ k[i % 2]}::HUGEINT AS {x}" for i, (v, x) in enumerate(zip(SIP_START, "abcd")))
    block = f"(coalesce(list_sum(list_transform(range(0, strlen(item)), lambda i: ('0x' || substr(hex(encode(item)), (2 * i + 1)::INT, 2))::HUGEINT * (1::HUGEINT << (8 * i)::INT))), 0) + strlen(item)::HUGEINT * {1 << 56}::HUGEINT)::HUGEINT"
    state = f"SELECT * REPLACE (xor(d, m) AS d) FROM (SELECT item, {block} AS m, {start} FROM ({source}))"
    state = f"SELECT * REPLACE (xor(a, m) AS a, xor(c, 255::HUGEINT) AS c) FROM ({_sip_round(_sip_round(state))})"
    for _ in range(4):
        state = _sip_round(state)
    return f"SELECT item, xor(xor(a, b), xor(c, d)) AS h FROM ({state})"


def bloom_cells(m: int, k: int) -> str:
    """The list of cells of a hash ``h``."""
    return f"list_distinct(list_transform(range(0, {k}), lambda i: ((h // {(1 << 64) // m}::HUGEINT + (h % {m}) * i) % {m})::BIGINT))"
