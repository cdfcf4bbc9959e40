"""Hash routing: slices of the key's SHA-1 as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.config import BARRELS, CHAINS, FANOUT


def digest(key: Column) -> Column:
    """SHA-1 of the key bytes, 40 hex characters."""
    return F.sha1(key)


def _hex_text(h: Column, first: int, last: int) -> Column:
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(last, first - 1, -1)])


def word(h: Column, first: int, last: int) -> Column:
    """Little-endian number in bytes first..last of the digest (seven bytes at most)."""
    return F.conv(_hex_text(h, first, last), 16, 10).cast("bigint")


def leaf_path(h: Column) -> Column:
    """Twelve routing bits: four levels of three bits."""
    return word(h, 0, 1).bitwiseAND(4095)


def slot(h: Column, level: int) -> Column:
    return F.shiftright(word(h, 0, 1), 3 * level).bitwiseAND(FANOUT - 1)


def node_path(h: Column, level: int) -> Column:
    """Path of the level's node: one octal digit a level, root digit first; the root is ''."""
    return F.concat(F.lit(""), *[slot(h, i).cast("string") for i in range(level)])


def barrel(h: Column) -> Column:
    """64-bit word at bytes 4..11 modulo 8191; 2**32 is 64 modulo 8191."""
    return F.pmod(word(h, 8, 11) * 64 + word(h, 4, 7), F.lit(BARRELS))


def chain(h: Column) -> Column:
    return word(h, 16, 19) % CHAINS


def move_order(h: Column, barrel_id: Column) -> Column:
    """32-bit word at bytes 12..15, rotated left by barrel modulo 32."""
    w, s = word(h, 12, 15), (barrel_id % 32).cast("int")
    # shiftleft takes a literal count in the Python API, a column in SQL
    turned = F.call_function("shiftleft", w, s).bitwiseAND(F.lit(4294967295)).bitwiseOR(F.call_function("shiftrightunsigned", w, 32 - s))
    return F.when(s == 0, w).otherwise(turned)


def bloom_hash(h: Column) -> Column:
    """64-bit word at bytes 12..19, as a signed number of the same bits."""
    return F.conv(_hex_text(h, 12, 19), 16, -10).cast("bigint")


def varint_length(n: Column) -> Column:
    """Bytes of the 7-bits-a-byte encoding of a 16-bit number."""
    return F.when(n < 128, 1).when(n < 16384, 2).otherwise(3)


def volume(key: Column, value: Column) -> Column:
    k, v = F.octet_length(key), F.octet_length(value)
    return (k + v + varint_length(k) + varint_length(v)).cast("bigint")


def little_endian(n: Column) -> Column:
    """Eight-byte little-endian key of a number."""
    octets = [F.shiftleft(F.shiftrightunsigned(n.cast("bigint"), 8 * i).bitwiseAND(255), 56 - 8 * i) for i in range(8)]
    return F.unhex(F.lpad(F.hex(_or(octets)), 16, "0"))


def hex_text(n: Column) -> Column:
    """Text key of a number: sixteen lower-case hex digits."""
    return F.lower(F.lpad(F.hex(n), 16, "0"))


def _or(parts: list[Column]) -> Column:
    return reduce(Column.bitwiseOR, parts)


def varint(n: Column) -> Column:
    """Bytes of a number from 0 on: seven bits each, the least first, the high bit set on all but the last.

    The first eight octets are made in one word, without higher-order functions, whose lambdas aren't compiled.
    """
    n = n.cast("bigint")
    seven = lambda i: F.shiftrightunsigned(n, 7 * i).bitwiseAND(127)
    digits = lambda x, width: F.lpad(F.hex(x), width, "0")
    word = _or([F.shiftleft(seven(i), 56 - 8 * i) for i in range(8)])
    code = F.when(n < 0, F.concat(digits(word.bitwiseOR(_first(8)), 16), digits(F.shiftleft(seven(8).bitwiseOR(128), 8).bitwiseOR(seven(9)), 4)))
    for size in range(1, 9):
        code = code.when(n < 128**size, F.substring(digits(word.bitwiseOR(_first(size - 1)), 16), 1, 2 * size))
    return F.unhex(code.otherwise(F.concat(digits(word.bitwiseOR(_first(8)), 16), digits(seven(8), 2))))


def _first(octets: int) -> Column:
    """The high bits of the first octets of a word, as a signed number."""
    bits = sum(128 << (56 - 8 * i) for i in range(octets))
    return F.lit(bits - 2**64 if bits >= 2**63 else bits).cast("bigint")


def varint_value(code: Column) -> Column:
    """Number of a varint; null where it does not end within ten bytes."""
    h = F.hex(code)
    number = lambda at, width: F.conv(F.rpad(F.substring(h, at, width), width, "F"), 16, -10).cast("bigint")
    word, rest = number(1, 16), number(17, 4)
    octets = [F.shiftrightunsigned(word, 56 - 8 * i) for i in range(8)] + [F.shiftrightunsigned(rest, 8), rest]
    total = _or([F.shiftleft(x.bitwiseAND(127), 7 * i) for i, x in enumerate(octets)])
    kept = F.lit(None).cast("bigint")
    for i in range(9, -1, -1):
        kept = F.when(octets[i].bitwiseAND(128) == 0, F.lit(2 ** (7 * i + 7) - 1 if i < 9 else -1).cast("bigint")).otherwise(kept)
    return total.bitwiseAND(kept)
