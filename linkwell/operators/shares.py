"""Functional models of additive shares with integrity tags, and of the projection check.

A share is (value, mac, key_id): columns ``<name>_value`` and so on, unsigned 64-bit
numbers as bigints. These reproduce results, not secrecy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwell.functions import words64 as w

#: Fixed values.
MASTER_KEY = 0xDEADBEEFCAFEBABE
SHARE_MASK = 0xCAFEBABEDEADBEEF
MIX_1, MIX_2, MIX_SHIFT = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 33
CHECK_SEED = 0xFACEFEED12345678


def mac(value: Column, round_: Column, key_id: Column, key: int = MASTER_KEY) -> Column:
    folded = lambda x: w.let(x, lambda y: w.xor(y, w.right(y, MIX_SHIFT)))
    times = lambda x, m: w.let(x, lambda y: w.multiply(y, w.literal(m)))
    x = w.xor(value, w.literal(key), round_.cast("long"), key_id.cast("long"))
    return folded(times(folded(times(folded(x), MIX_1)), MIX_2))


def share(df: DataFrame, value: str, round_: str, key: int = MASTER_KEY) -> DataFrame:
    """``df`` with two shares of a value, s0 and s1."""
    r = w.xor(F.shiftleft(F.col(round_).cast("long"), 32), w.literal(SHARE_MASK))
    rows = df.withColumn("s0_value", r).withColumn("s1_value", w.add(F.col(value), w.negated(F.col("s0_value"))))
    for i in (0, 1):
        rows = rows.withColumn(f"s{i}_key_id", F.lit(i).cast("long"))
        rows = rows.withColumn(f"s{i}_mac", mac(F.col(f"s{i}_value"), F.col(round_), F.col(f"s{i}_key_id"), key))
    return rows


def verified(value: Column, tag: Column, key_id: Column, round_: Column, key: int = MASTER_KEY) -> Column:
    return (key_id >= 0) & (key_id <= 1) & (mac(value, round_, key_id, key) == tag)


def reconstructed(a: Column, b: Column) -> Column:
    return w.add(a, b)


def added(df: DataFrame, a: str, b: str, out: str, round_: str, key: int = MASTER_KEY) -> DataFrame:
    """``df`` with the share of a sum; fails where a share is not verified."""
    return _combined(df, a, b, out, round_, w.add(F.col(f"{a}_value"), F.col(f"{b}_value")), F.lit(True), key)


def multiplied_bits(df: DataFrame, a: str, b: str, out: str, round_: str, key: int = MASTER_KEY) -> DataFrame:
    """``df`` with the share of a product of bits; fails on other values and on unverified shares."""
    bits = F.col(f"{a}_value").isin(0, 1) & F.col(f"{b}_value").isin(0, 1)
    return _combined(df, a, b, out, round_, F.col(f"{a}_value").bitwiseAND(F.col(f"{b}_value")), bits, key)


def _combined(df: DataFrame, a: str, b: str, out: str, round_: str, value: Column, fits: Column, key: int) -> DataFrame:
    valid = lambda x: verified(F.col(f"{x}_value"), F.col(f"{x}_mac"), F.col(f"{x}_key_id"), F.col(round_), key)
    checked = F.when(~(valid(a) & valid(b)), F.raise_error(F.lit("a share was not verified"))).when(~fits, F.raise_error(F.lit("not shares of bits"))).otherwise(value)
    rows = df.withColumn(f"{out}_value", checked.cast("long")).withColumn(f"{out}_key_id", F.col(f"{a}_key_id"))
    return rows.withColumn(f"{out}_mac", mac(F.col(f"{out}_value"), F.col(round_), F.col(f"{out}_key_id"), key))


def commitment(seed: Column) -> Column:
    """What a party publishes before it reveals its seed."""
    return F.md5(seed.cast("string"))


def joint_seed(a: Column, b: Column, commitment_a: Column) -> Column:
    """The seeds' exclusive or; fails if the first does not fit its commitment."""
    return F.when(commitment(a) == commitment_a, a.bitwiseXOR(b)).otherwise(F.raise_error(F.lit("commitment failure")).cast("long"))


def check_weights(length: int, seed: int = CHECK_SEED) -> list[int]:
    """Odd 64-bit weights, one for each place of a mask."""
    mask, state, out = (1 << 64) - 1, seed, []
    for _ in range(length):
        state = (state ^ (state << 13) ^ (state >> 7) ^ (state << 17)) & mask
        out.append(state | 1)
    return out


def projection_holds(original: Column, projected: Column, n_projected: Column, mask: Column, length: int, weights: Column) -> Column:
    """Whether a projection fits the original and the mask, by weighted sums mod 2^64.

    original: set positions; projected: set places of the projection, from 0; mask: positions;
    weights: bigints for each place. Wrong lengths and positions beyond ``length`` fail.
    """
    places = F.when(F.size(mask) > 0, F.sequence(F.lit(0), F.size(mask) - 1)).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0).cast("long")
    left = F.aggregate(F.filter(places, lambda i: F.array_contains(projected, i.cast("long"))), zero, lambda a, i: w.add(a, F.get(weights, i)))
    right = F.aggregate(F.filter(places, lambda i: F.array_contains(original, F.get(mask, i))), zero, lambda a, i: w.add(a, F.get(weights, i)))
    return (F.size(mask) == n_projected) & ~F.exists(mask, lambda p: (p < 0) | (p >= length)) & (left == right)


def checked_projections(rows: DataFrame, drawn: list[list[int]], seed: int = CHECK_SEED) -> DataFrame:
    """(round, party, idx, bits, projected) -> plus sum_projected, sum_original: equal iff the check passes.

    The sums as joins: a table of one weight for each place of each mask, whose size is
    that of the masks.
    """
    spark = rows.sparkSession
    table = [(r, b, x - (1 << 64) if x >> 63 else x) for r, mask in enumerate(drawn) for b, x in zip(mask, check_weights(len(mask), seed), strict=True)]
    weights = F.broadcast(spark.createDataFrame(table, "round bigint, bit bigint, weight bigint"))
    unsigned = F.col("weight").cast("decimal(38,0)") + F.when(F.col("weight") < 0, F.lit("18446744073709551616").cast("decimal(38,0)")).otherwise(F.lit(0))

    def total(column: str, name: str) -> DataFrame:
        bits = rows.select("round", "party", "idx", F.explode(column).alias("bit")).join(weights, ["round", "bit"])
        return bits.groupBy("round", "party", "idx").agg((F.sum(unsigned) % F.lit("18446744073709551616").cast("decimal(38,0)")).cast("decimal(20,0)").alias(name))

    keys, none = ["round", "party", "idx"], F.lit(0).cast("decimal(20,0)")
    out = rows.join(total("projected", "sum_projected"), keys, "left").join(total("bits", "sum_original"), keys, "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("sum_projected", "sum_original")})
