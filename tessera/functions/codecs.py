"""Base-58 numbers, 8-bit flags, TLV records and random sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits and letters without 0, O, I and l. Fixed value.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
WIDE = "decimal(38,0)"
TWO64 = 1 << 64
#: The largest prime below 2^32 that leaves 3 when divided by 4. Fixed value.
RANDOM_PRIME = 4294967291


def _wide(value: int) -> Column:
    return F.lit(str(value)).cast(WIDE)


def base58_encode(n: Column) -> Column:
    """Text of a number from 0 to 2^64 - 1 (BIGINT or DECIMAL); null for null or negative."""
    def step(s: Column, i: Column) -> Column:
        digit = (s["left"] % 58).cast("int")
        text = F.concat(F.substring(F.lit(ALPHABET), digit + 1, F.lit(1)), s["text"])
        rest = ((s["left"] - digit.cast(WIDE)) / 58).cast(WIDE)
        return F.when((s["left"] == 0) & (i > 0), s).otherwise(F.struct(rest.alias("left"), text.alias("text")))

    digits = F.aggregate(F.sequence(F.lit(0), F.lit(10)), F.struct(n.cast(WIDE).alias("left"), F.lit("").alias("text")), step, lambda s: s["text"])
    return F.when(n >= 0, digits)


def base58_decode(text: Column) -> Column:
    """DECIMAL(20,0) of a base-58 text, modulo 2^64; null for null, empty or texts with other characters."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    values = F.transform(letters, lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    total = F.aggregate(values, _wide(0), lambda a, v: ((a * 58 + v).cast(WIDE) % _wide(TWO64)).cast(WIDE))
    sound = (F.length(text) > 0) & F.forall(values, lambda v: v >= 0)
    return F.when(sound, total.cast("decimal(20,0)"))


def base58_reverse(text: Column) -> Column:
    """The digits in the other order."""
    return F.reverse(text)


# Flags are SMALLINT from 0 to 255.


def flag_set_all(flag: Column, *options: int) -> Column:
    for o in options:
        flag = flag.bitwiseOR(F.lit(o))
    return flag.cast("smallint")


def flag_toggle_all(flag: Column, *options: int) -> Column:
    for o in options:
        flag = flag.bitwiseXOR(F.lit(o))
    return flag.cast("smallint")


def flag_clear_all(flag: Column, *options: int) -> Column:
    for o in options:
        flag = flag.bitwiseAND(F.lit(~o & 255))
    return flag.cast("smallint")


def flag_are_all_set(flag: Column, *options: int) -> Column:
    """Whether each option shares a bit with the flag (an option of several bits needs one of them); true without options."""
    out = F.lit(True)
    for o in options:
        out = out & (flag.bitwiseAND(F.lit(o)) != 0)
    return out


def flag_is_any_set(flag: Column, *options: int) -> Column:
    """Whether some option shares a bit with the flag; false without options."""
    out = F.lit(False)
    for o in options:
        out = out | (flag.bitwiseAND(F.lit(o)) != 0)
    return out


def _bit(n: Column) -> Column:
    return F.get(F.array(*(F.lit(1 << i) for i in range(8))), F.least(n, F.lit(7)).cast("int"))


def flag_is_set(flag: Column, n: Column) -> Column:
    """Bit n of the flag; false beyond 7."""
    return (n <= 7) & (flag.bitwiseAND(_bit(n)) != 0)


def flag_set(flag: Column, n: Column) -> Column:
    """Bit n set; unchanged beyond 7. The same holds for toggle and clear."""
    return F.when(n <= 7, flag.bitwiseOR(_bit(n))).otherwise(flag).cast("smallint")


def flag_toggle(flag: Column, n: Column) -> Column:
    return F.when(n <= 7, flag.bitwiseXOR(_bit(n))).otherwise(flag).cast("smallint")


def flag_clear(flag: Column, n: Column) -> Column:
    return F.when(n <= 7, flag.bitwiseAND(F.bitwise_not(_bit(n)))).otherwise(flag).cast("smallint")


def flag_reset() -> Column:
    return F.lit(0).cast("smallint")


def _little_endian(value: Column, width: int) -> Column:
    """A number in ``width`` bytes, least first; higher bits are cut off."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(value.cast("bigint"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(width))))


def tlv_encode(kind: Column, payload: Column, type_bytes: int = 1, length_bytes: int = 2) -> Column:
    """One record: type and length in little-endian of the given widths (1, 2, 4 or 8), then the payload. Values are cut to their width."""
    for width in (type_bytes, length_bytes):
        if width not in (1, 2, 4, 8):
            raise ValueError("widths are 1, 2, 4 or 8 bytes")
    return F.concat(_little_endian(kind, type_bytes), _little_endian(F.octet_length(payload), length_bytes), payload)


def _number(data: Column, width: int) -> Column:
    out = F.lit(0).cast("bigint")
    for i in range(width):
        out = out.bitwiseOR(F.shiftleft(F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("bigint"), 8 * i))
    return out


def tlv_decode(record: Column, type_bytes: int = 1, length_bytes: int = 2) -> Column:
    """STRUCT(type BIGINT, payload BINARY) of a single record; null if it is shorter than it says."""
    size = _number(F.substring(record, type_bytes + 1, length_bytes), length_bytes)
    head = type_bytes + length_bytes
    whole = F.octet_length(record) >= size + head
    return F.when(whole, F.struct(_number(record, type_bytes).alias("type"), F.substring(record, F.lit(head + 1), size.cast("int")).alias("payload")))


def random_permuted(x: Column) -> Column:
    """A bijection of 0 .. 2^32 - 1: squares modulo RANDOM_PRIME, the upper half mirrored; numbers from the prime on stay."""
    wide = x.cast(WIDE)
    residue = ((wide * wide).cast(WIDE) % RANDOM_PRIME).cast("bigint")
    return F.when(x >= RANDOM_PRIME, x).when(x <= RANDOM_PRIME // 2, residue).otherwise(F.lit(RANDOM_PRIME) - residue).cast("bigint")


#: Published offsets of the random sequence.
RANDOM_BASE, RANDOM_OFFSET, RANDOM_FLIP = 0x682F0161, 0x46790905, 0x5BF03635


def random_sequence(n: Column, seed_base: int, seed_offset: int) -> Column:
    """The n-th number (from 0) of a sequence that runs through all of 0 .. 2^32 - 1 without a repeat."""
    mask = F.lit(0xFFFFFFFF)

    def plain(x: int) -> int:
        if x >= RANDOM_PRIME:
            return x
        residue = x * x % RANDOM_PRIME
        return residue if x <= RANDOM_PRIME // 2 else RANDOM_PRIME - residue

    index = (plain((plain(seed_base) + RANDOM_BASE) & 0xFFFFFFFF) + n).bitwiseAND(mask)
    offset = plain((plain(seed_offset) + RANDOM_OFFSET) & 0xFFFFFFFF)
    return random_permuted((random_permuted(index) + offset).bitwiseAND(mask).bitwiseXOR(F.lit(RANDOM_FLIP)))
