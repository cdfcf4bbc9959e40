"""Reproducible synthetic numbers: every draw is an expression of a uniform u in [0, 1)."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THETA = 0.99
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211  # fixed values


def uniform_of(x: Column) -> Column:
    """u in [0, 1) from the first 32 SHA-1 bits of a number's decimal text."""
    return F.conv(F.substring(F.sha1(x.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def constant(value: int) -> Column:
    return F.lit(value).cast("bigint")


def counter(spark: SparkSession, start: int, n: int) -> DataFrame:
    return spark.range(start, start + n).withColumnRenamed("id", "value")


def uniform(u: Column, low: int, high: int) -> Column:
    return (F.lit(low) + F.floor(u * (high - low))).cast("bigint")


def exponential(u: Column, percent: float, span: float) -> Column:
    """The given percentage of draws is below ``span``."""
    gamma = -math.log(1 - percent / 100) / span
    return F.floor(-F.log(F.greatest(u, F.lit(2.0**-33))) / gamma).cast("bigint")


@cache
def zeta(n: int, theta: float = THETA) -> float:
    """Sum of i**-theta for i in 1..n; beyond a million terms by the Euler-Maclaurin tail."""
    m = min(n, 1_000_000)
    total = math.fsum(i**-theta for i in range(1, m + 1))
    if n > m:
        total += (n ** (1 - theta) - m ** (1 - theta)) / (1 - theta) + (n**-theta - m**-theta) / 2
    return total


def zipf_constants(low: int, high: int) -> tuple[int, float, float, float]:
    """(n, zeta(n), eta, alpha) of the range."""
    n = high - low
    eta = (1 - (2.0 / n) ** (1 - THETA)) / (1 - zeta(2) / zeta(n))
    return n, zeta(n), eta, 1 / (1 - THETA)


def zipfian(u: Column, low: int, high: int) -> Column:
    n, zn, eta, alpha = zipf_constants(low, high)
    tail = F.lit(low) + F.floor(F.lit(float(n)) * F.pow(F.lit(eta) * (u - 1.0) + 1.0, F.lit(alpha)))
    return F.when(u * zn < 1.0, low).when(u * zn < 1.0 + 0.5**THETA, low + 1).otherwise(tail).cast("bigint")


def fnv1a(x: Column) -> Column:
    """FNV-1a over the eight little-endian bytes of a number, as decimal(20,0)."""
    dec = lambda v: F.lit(str(v)).cast("decimal(20,0)")

    def octet(a: Column, i: Column) -> Column:
        low = (a % dec(256)).cast("bigint")
        byte = F.call_function("shiftrightunsigned", x.cast("bigint"), (i * 8).cast("int")).bitwiseAND(255)
        mixed = (a - low.cast("decimal(20,0)") + low.bitwiseXOR(byte).cast("decimal(20,0)")).cast("decimal(20,0)")
        return ((mixed * F.lit(FNV_PRIME).cast("decimal(13,0)")) % dec(2**64)).cast("decimal(20,0)")

    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), dec(FNV_OFFSET), octet)


def scrambled_zipfian(u: Column, low: int, high: int) -> Column:
    return (F.lit(low) + (fnv1a(zipfian(u, low, high)) % F.lit(high - low).cast("decimal(20,0)")).cast("bigint")).cast("bigint")


def by_name(name: str | None, number: Column | None = None):
    """Generator by a prefix of its name: (u, low, high) -> column; uniform when unknown.

    A counter counts from ``low`` by ``number``, a column that numbers the rows from 0.
    """
    if name == "":
        raise ValueError("empty generator name")
    known = {"constant": lambda u, a, b: constant(a), "counter": None, "exponential": lambda u, a, b: exponential(u, 95.0, float(b)), "zipfian": zipfian, "xzipfian": scrambled_zipfian, "uniform": uniform}
    hit = [k for k in ("counter", "exponential", "zipfian", "xzipfian", "uniform", "constant") if name and k.startswith(name)]
    if hit and hit[0] == "counter":
        if number is None:
            raise ValueError("a counter needs the rows' numbers")
        return lambda u, a, b: F.lit(a) + number
    return known[hit[0]] if hit else uniform
