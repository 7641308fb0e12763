"""Unsigned 64-bit arithmetic on bigint columns: all bits count, results wrap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW32, LOW16 = 0xFFFFFFFF, 0xFFFF


def literal(value: int) -> Column:
    """The signed bigint of an unsigned value."""
    value &= (1 << 64) - 1
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def right(x: Column, by: int) -> Column:
    return F.shiftrightunsigned(x, by)


def xor(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseXOR(p)
    return out


def negated(x: Column) -> Column:
    return add(F.bitwise_not(x), literal(1))


def add(a: Column, b: Column) -> Column:
    low = a.bitwiseAND(F.lit(LOW32)) + b.bitwiseAND(F.lit(LOW32))
    high = right(a, 32) + right(b, 32) + right(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(LOW32)))


def multiply(a: Column, b: Column) -> Column:
    """By limbs of 16 bits; no partial sum leaves 63 bits."""
    limb = lambda x, i: right(x, 16 * i).bitwiseAND(F.lit(LOW16).cast("long"))
    carry, out = None, None
    for i in range(4):
        here = None
        for j in range(i + 1):
            product = limb(a, j) * limb(b, i - j)
            here = product if here is None else here + product
        here = here if carry is None else here + carry
        part = F.shiftleft(here.bitwiseAND(F.lit(LOW16).cast("long")), 16 * i)
        out = part if out is None else out.bitwiseOR(part)
        carry = right(here, 16)
    return out
