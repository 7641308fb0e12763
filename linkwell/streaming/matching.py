"""Matching of new records as they arrive against a table of known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkwell.config import DEFAULT, LinkageConfig
from linkwell.functions.distance import hamming
from linkwell.operators.blocking import capped, encoded, projections
from linkwell.sources.names import records


def known_blocks(party0: DataFrame, drawn: list[list[int]], config: LinkageConfig = DEFAULT) -> DataFrame:
    """(round, key_hash, a_idx, a_name, a_bits): at most ``representatives`` of a bucket, as in a batch; to be
    written once, by round and key."""
    enc = encoded(records(party0, party0.limit(0)), config)
    keys = capped(projections(enc, drawn, config), config).select("round", "key_hash", F.col("idx").alias("a_idx"))
    return keys.join(enc.select(F.col("idx").alias("a_idx"), F.col("name").alias("a_name"), F.col("bits").alias("a_bits")), "a_idx")


def match_stream(arrivals: DataFrame, blocks: DataFrame, drawn: list[list[int]], path: str, checkpoint: str, config: LinkageConfig = DEFAULT) -> StreamingQuery:
    """Appends the matches of each micro-batch of (idx, name) to ``path``; a restart resumes at the last batch.

    A batch that runs again overwrites its own folder, so each match is written once. Of a batch's
    bucket at most ``representatives`` arrivals meet the known ones, so a hot bucket stays small.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        enc = encoded(records(df.limit(0), df), config)
        keys = capped(projections(enc, drawn, config), config).select("round", "key_hash", F.col("idx").alias("b_idx"))
        pairs = keys.join(blocks, ["round", "key_hash"]).groupBy("a_idx", "b_idx")
        pairs = pairs.agg(F.min("round").alias("round"), F.first("a_name").alias("a_name"), F.first("a_bits").alias("a_bits"))
        rows = pairs.join(enc.select(F.col("idx").alias("b_idx"), F.col("name").alias("b_name"), F.col("bits").alias("b_bits")), "b_idx")
        rows = rows.withColumn("payload_dist", hamming(F.col("a_bits"), F.col("b_bits"))).where(F.col("payload_dist") <= config.threshold)
        rows.drop("a_bits", "b_bits").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
