"""Distances and comparisons of vectors and of token lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkwell.config import DEFAULT, LinkageConfig


def hamming(a: Column, b: Column) -> Column:
    """Positions in which two vectors of the same length differ."""
    return (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))).cast("long")


def xor(a: Column, b: Column) -> Column:
    return F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a)))


def hamming_words(a: Column, b: Column) -> Column:
    """The same on arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)


def masked(match: Column, chunks: Column) -> Column:
    """The chunks where there is a match, zeros of the same length elsewhere."""
    return F.when(match, chunks).otherwise(F.transform(chunks, lambda c: (c - c).cast("decimal(20,0)")))


def bounded_levenshtein(a: Column, b: Column, most: int) -> Column:
    """The edit distance, or most + 1 if it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def subset_relation(a: Column, b: Column, least: int = DEFAULT.min_shared_tokens) -> Column:
    """Both lists have ``least`` different tokens or more, and one holds all of the other's."""
    enough = (F.size(F.array_distinct(a)) >= least) & (F.size(F.array_distinct(b)) >= least)
    return enough & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def near_token_match(a: Column, b: Column, config: LinkageConfig = DEFAULT) -> Column:
    """Tokens of ``a``, in turn, each take an equal token of ``b`` or else the first that is
    near; all must find one, and one at least must be near only."""

    def without(tokens: Column, at: Column) -> Column:
        return F.concat(F.slice(tokens, F.lit(1), at - 1), F.slice(tokens, at + 1, F.size(tokens)))

    def step(state: Column, t: Column) -> Column:
        left = state["left"]
        equal = F.array_position(left, t).cast("int")

        def near(x: Column) -> Column:
            long_enough = F.least(F.length(t), F.length(x)) >= config.min_token_length
            return long_enough & (bounded_levenshtein(t, x, config.max_token_edit) <= config.max_token_edit)

        close = F.array_position(F.transform(left, near), F.lit(True)).cast("int")
        at = F.when(equal > 0, equal).otherwise(close)
        return F.struct(
            F.when(at > 0, without(left, F.greatest(at, F.lit(1)))).otherwise(left).alias("left"),
            (state["used"] | ((equal == 0) & (close > 0))).alias("used"),
            (state["ok"] & (at > 0)).alias("ok"),
        )

    start = F.struct(b.alias("left"), F.lit(False).alias("used"), F.lit(True).alias("ok"))
    return F.when(F.size(a) == F.size(b), F.aggregate(a, start, step, lambda s: s["ok"] & s["used"])).otherwise(F.lit(False))
