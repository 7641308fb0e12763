"""Fixed-width forms of (index, name) records and of buckets of them, little-endian."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkwell.config import DEFAULT, LinkageConfig


def _le32(x: Column) -> Column:
    h = F.lpad(F.hex(x), 8, "0")
    return F.concat(*[F.substring(h, at, 2) for at in (7, 5, 3, 1)])


def _from_le32(h: Column, at: int) -> Column:
    return F.conv(F.concat(*[F.substring(h, at + i, 2) for i in (6, 4, 2, 0)]), 16, 10).cast("long")


def clamped(name: Column, config: LinkageConfig = DEFAULT) -> Column:
    """The first bytes of a name, in hexadecimal."""
    return F.substring(F.hex(F.encode(F.coalesce(name, F.lit("")), "UTF-8")), 1, 2 * config.name_bytes)


def serialized_hex(idx: Column, name: Column, config: LinkageConfig = DEFAULT) -> Column:
    """Index, length of the name, and the name filled with zeros, in hexadecimal."""
    body = clamped(name, config)
    return F.concat(_le32(idx), _le32((F.length(body) / 2).cast("long")), F.rpad(body, 2 * config.name_bytes, "0"))


def serialized(idx: Column, name: Column, config: LinkageConfig = DEFAULT) -> Column:
    return F.unhex(serialized_hex(idx, name, config))


def deserialized(value: Column, config: LinkageConfig = DEFAULT) -> Column:
    """struct<idx, name> of a serialized record; fails on a length beyond the width. A letter
    that the clamp cut comes back as a replacement character."""
    h = F.hex(value)
    n = _from_le32(h, 9)
    body = F.unhex(F.substring(h, F.lit(17), (2 * n).cast("int")))
    name = F.when(n <= config.name_bytes, F.decode(body, "UTF-8")).otherwise(F.raise_error(F.lit("invalid name length")).cast("string"))
    return F.struct(_from_le32(h, 1).alias("idx"), name.alias("name"))


def serialized_bucket(values: Column, config: LinkageConfig = DEFAULT) -> Column:
    """A count and as many serialized records (an array of hexadecimal), filled up to the cap; fails beyond it."""
    width = 2 * (8 + config.name_bytes) * config.representatives
    body = F.rpad(F.array_join(values, ""), width, "0")
    fits = F.size(values) <= config.representatives
    return F.unhex(F.when(fits, F.concat(_le32(F.size(values)), body)).otherwise(F.raise_error(F.lit("a bucket exceeds the cap")).cast("string")))


def deserialized_bucket(bucket: Column, config: LinkageConfig = DEFAULT) -> Column:
    """The array of struct<idx, name> of a bucket; fails on a wrong length or count."""
    one, h = 2 * (8 + config.name_bytes), F.hex(bucket)
    n = _from_le32(h, 1)
    fits = (F.length(h) == 8 + one * config.representatives) & (n <= config.representatives)
    n = F.when(fits, n).otherwise(F.raise_error(F.lit("unexpected length or count of a bucket")).cast("long"))
    places = F.filter(F.sequence(F.lit(0), F.lit(config.representatives - 1)), lambda i: i < n)
    return F.transform(places, lambda i: deserialized(F.unhex(F.substring(h, 9 + i * one, F.lit(one))), config))
