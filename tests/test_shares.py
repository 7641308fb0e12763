import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkwell.functions import words64 as w
from linkwell.operators import shares

KEY, ROUND, SECRET = 0x1234567890ABCDEF, 7, 42


def signed(x):
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def test_arithmetic_wraps(spark):
    number = st.integers(0, (1 << 64) - 1)

    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.tuples(number, number), min_size=100, max_size=120))
    def check(pairs):
        pairs = [*pairs, ((1 << 64) - 1,) * 2, (1 << 63, 2), (0, 0)]
        rows = spark.createDataFrame([(i, signed(a), signed(b)) for i, (a, b) in enumerate(pairs)], "i int, a bigint, b bigint")
        a, b = F.col("a"), F.col("b")
        got = rows.select("i", w.add(a, b), w.multiply(a, b), w.negated(a)).orderBy("i").collect()
        assert [tuple(r)[1:] for r in got] == [(signed(x + y), signed(x * y), signed(-x)) for x, y in pairs]

    check()


@pytest.fixture
def shared(spark):
    return shares.share(spark.createDataFrame([(ROUND, SECRET)], "round bigint, secret bigint"), "secret", "round", KEY)


def one(df, column):
    return df.select(column).first()[0]


def valid(value, tag, key_id, round_):
    return shares.verified(value, tag, key_id, round_, KEY)


def test_shares_open_and_verify(shared):
    c = F.col
    assert one(shared, shares.reconstructed(c("s0_value"), c("s1_value"))) == SECRET
    for i in (0, 1):
        assert one(shared, valid(c(f"s{i}_value"), c(f"s{i}_mac"), c(f"s{i}_key_id"), c("round")))
        assert not one(shared, valid(c(f"s{i}_value"), c(f"s{i}_mac"), c(f"s{i}_key_id"), c("round") + 1))
    assert not one(shared, valid(w.xor(c("s0_value"), w.literal(1)), c("s0_mac"), c("s0_key_id"), c("round")))
    assert not one(shared, valid(c("s0_value"), w.literal(0), c("s0_key_id"), c("round")))
    assert not one(shared, valid(c("s0_value"), c("s0_mac"), F.lit(9), c("round")))


def test_sum_and_product(shared):
    c = F.col
    rows = shares.added(shared, "s0", "s0", "sum", "round", KEY)
    assert one(rows, valid(c("sum_value"), c("sum_mac"), c("sum_key_id"), c("round")))
    assert one(rows, c("sum_value")) == signed(2 * one(rows, c("s0_value")))
    with pytest.raises(Exception, match="not shares of bits"):
        shares.multiplied_bits(shared, "s1", "s1", "p", "round", KEY).collect()
    with pytest.raises(Exception, match="not verified"):
        shares.added(shared.withColumn("s1_mac", F.lit(0).cast("long")), "s0", "s1", "sum", "round", KEY).collect()
    bit = shared.withColumn("b_value", F.lit(1).cast("long")).withColumn("b_key_id", F.lit(0).cast("long"))
    bit = bit.withColumn("b_mac", shares.mac(c("b_value"), c("round"), c("b_key_id"), KEY))
    assert one(shares.multiplied_bits(bit, "b", "b", "p", "round", KEY), c("p_value")) == 1


def test_commitment(spark):
    rows = spark.range(1).select(F.lit(5).cast("long").alias("a"), F.lit(9).cast("long").alias("b"))
    a, b = F.col("a"), F.col("b")
    assert one(rows, shares.joint_seed(a, b, shares.commitment(a))) == 5 ^ 9
    with pytest.raises(Exception, match="commitment failure"):
        rows.select(shares.joint_seed(a, b, shares.commitment(b))).collect()


@pytest.mark.parametrize(
    ("original", "projected", "n", "mask", "holds"),
    [
        ([2, 5, 7], [0, 1, 2], 3, [2, 7, 5], True),
        ([2, 5, 7], [0, 2], 3, [2, 7, 5], False),
        ([2, 5, 7], [], 2, [2, 7, 5], False),
        ([2, 5, 7], [0, 1, 2], 3, [2, 7, 25], False),
        ([2, 5], [0, 1, 2], 3, [2, 7, 5], False),
        ([], [], 0, [], True),
    ],
)
def test_projection_check(spark, original, projected, n, mask, holds):
    weights = [signed(x) for x in shares.check_weights(8, 0x1234)]
    rows = spark.createDataFrame([(original, projected, n, mask, weights)], "o array<bigint>, p array<bigint>, n int, m array<bigint>, w array<bigint>")
    assert one(rows, shares.projection_holds(*map(F.col, "opnm"), 20, F.col("w"))) is holds
