"""Blocking: projections of encoded records, capped buckets, candidate pairs.

Rows carry ids and a 128-bit key hash only. Spark cuts each task's part of a bucket to its
first rows before the exchange that ranks them, so a bucket of any size reaches its task
as a few rows from each other task; the second exchange, where the parties meet, has capped
rows only, and what leaves it is at most representatives^2 pairs a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwell.config import DEFAULT, LinkageConfig
from linkwell.functions.encode import encode_token_or, hash_unit, key_hash, masks, membership, project, projection_key
from linkwell.functions.records import serialized_bucket, serialized_hex


def encoded(records: DataFrame, config: LinkageConfig = DEFAULT, kind: str = "md5") -> DataFrame:
    """Valid records with their bits."""
    return records.where("valid").select("party", "idx", "name", encode_token_or(F.col("name"), config, kind).alias("bits"))


def projections(enc: DataFrame, drawn: list[list[int]], config: LinkageConfig = DEFAULT) -> DataFrame:
    """(round, party, idx, key): every record under every mask."""
    member = membership(drawn, config)
    rounds = F.sequence(F.lit(0), F.lit(config.rounds - 1))
    keys = F.transform(rounds, lambda r: projection_key(project(F.col("bits"), member, r)))
    rows = enc.select("party", "idx", F.posexplode(keys).alias("round", "key"))
    return rows.select(F.col("round").cast("long").alias("round"), "party", "idx", "key")


def _order(config: LinkageConfig):
    return hash_unit("pick", config.seed, F.col("round"), F.col("party"), F.col("idx"))


def capped(projected: DataFrame, config: LinkageConfig = DEFAULT) -> DataFrame:
    """(round, party, key_hash, idx, place): at most ``representatives`` of each party in a bucket."""
    rows = projected.select("round", "party", "idx", key_hash(F.col("key")).alias("key_hash"))
    order = Window.partitionBy("round", "key_hash", "party").orderBy(_order(config), "idx")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= config.representatives)


def bucket_stats(projected: DataFrame, config: LinkageConfig = DEFAULT) -> DataFrame:
    """Per round and party: buckets, records, the largest bucket before and after the cap."""
    sizes = projected.groupBy("round", "party", key_hash(F.col("key")).alias("key_hash")).agg(F.count("*").alias("n"))
    return sizes.groupBy("round", "party").agg(
        F.count("*").alias("n_buckets"),
        F.sum("n").alias("n_records"),
        F.max("n").alias("max_bucket"),
        F.max(F.least("n", F.lit(config.representatives).cast("long"))).alias("max_bucket_capped"),
    )


def sender_buckets(cap: DataFrame, enc: DataFrame, config: LinkageConfig = DEFAULT) -> DataFrame:
    """(round, key_hash, bucket): party 0's capped buckets in fixed-width form."""
    rows = cap.where("party = 0").join(enc.where("party = 0").select("idx", "name"), "idx")
    values = rows.groupBy("round", "key_hash").agg(F.array_sort(F.collect_list(F.struct("place", "idx", "name"))).alias("v"))
    return values.select("round", "key_hash", serialized_bucket(F.transform("v", lambda x: serialized_hex(x["idx"], x["name"], config)), config).alias("bucket"))


def meetings(cap: DataFrame) -> DataFrame:
    """(round, key_hash, a, b): the representatives of buckets that both parties have."""
    side = lambda p: F.array_sort(F.collect_list(F.when(F.col("party") == p, F.col("idx"))))
    return cap.groupBy("round", "key_hash").agg(side(0).alias("a"), side(1).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))


def expanded(met: DataFrame) -> DataFrame:
    """(round, a_idx, b_idx): all pairs of the representatives of a bucket."""
    rows = met.select("round", "key_hash", F.explode("a").alias("a_idx"), "b")
    return rows.select("round", "key_hash", "a_idx", F.explode("b").alias("b_idx"))


def round_stats(met: DataFrame) -> DataFrame:
    """Per round: common buckets, pairs before de-duplication, new pairs, pairs seen in earlier rounds."""
    per_round = met.groupBy("round").agg(F.count("*").alias("n_common"), F.sum(F.size("a") * F.size("b")).cast("long").alias("n_pairs"))
    new = candidates(met).groupBy("round").agg(F.count("*").alias("n_new"))
    joined = per_round.join(new, "round", "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)).cast("long"))
    return joined.select("round", "n_common", "n_pairs", "n_new", (F.col("n_pairs") - F.col("n_new")).alias("n_repeated"))


def candidates(met: DataFrame) -> DataFrame:
    """(a_idx, b_idx, round): each pair once, with the first round that found it."""
    return expanded(met).groupBy("a_idx", "b_idx").agg(F.min("round").alias("round"))


def numbered(pairs: DataFrame) -> DataFrame:
    """Candidates with dense ids from 0, in the order of round and indices.

    Ids are dense in three steps: after the counts of earlier rounds, in a round after those of earlier
    ranges of a_idx, then in order. No task sees all pairs, or all ranges.
    """
    width = 4096
    cell = F.expr(f"a_idx div {width}")
    pairs = pairs.withColumn("cell", cell)
    counts = pairs.groupBy("round", "cell").agg(F.count("*").alias("n"))
    rows_before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rounds = counts.groupBy("round").agg(F.sum("n").alias("n"))  # a row a round
    rounds = rounds.select("round", F.coalesce(F.sum("n").over(rows_before(Window.orderBy("round"))), F.lit(0)).alias("round_base"))
    cell_base = F.coalesce(F.sum("n").over(rows_before(Window.partitionBy("round").orderBy("cell"))), F.lit(0))
    counts = counts.select("round", "cell", cell_base.alias("cell_base")).join(F.broadcast(rounds), "round")
    inside = Window.partitionBy("round", "cell").orderBy("a_idx", "b_idx")
    rows = pairs.withColumn("no", F.row_number().over(inside) - 1).join(counts, ["round", "cell"])
    return rows.select((F.col("round_base") + F.col("cell_base") + F.col("no")).cast("long").alias("candidate_id"), "round", "a_idx", "b_idx")


def candidate_pairs(records: DataFrame, n: int, config: LinkageConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(encoded records, candidate pairs) of (party, idx, name, valid) for tables of n records."""
    enc = encoded(records, config)
    return enc, candidates(meetings(capped(projections(enc, masks(n, config), config), config)))
