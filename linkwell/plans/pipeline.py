"""The linkage end to end, as one lazy plan over the driver's tables."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwell.config import DEFAULT, LinkageConfig
from linkwell.functions.encode import masks
from linkwell.operators import blocking, evaluate, synth, verify
from linkwell.sources import names


@dataclass
class Linkage:
    """Clean names of a table against their noisy copies, step by step."""

    spark: SparkSession
    clean: DataFrame  # (idx, name)
    config: LinkageConfig = DEFAULT
    noisy: DataFrame | None = None  # (idx, name, fuzzy_name, error_type, is_noisy); by default made from the clean names

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, config: LinkageConfig = DEFAULT) -> Linkage:
        return cls(spark, names.document_names(spark.read.parquet(f"{sf_dir}/documents.parquet")), config)

    @classmethod
    def of_files(cls, spark: SparkSession, clean: str, fuzzy: str, config: LinkageConfig = DEFAULT) -> Linkage:
        """Two CSV files of names, row by row, their first ``config.row_limit`` rows (0: all)."""
        a = names.read_names(spark, clean, "full_name_romanised", config.row_limit)
        rows = names.limited(names.positioned(names.read_csv(spark, fuzzy)), config.row_limit)
        if a.count() != rows.count():
            raise ValueError("both files must have as many rows")
        told = [F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (("error_type", "string"), ("is_noisy", "boolean"))]
        b = rows.select("idx", F.coalesce("fuzzy_name", F.lit("")).alias("fuzzy_name"), *told)
        return cls(spark, a, config, a.join(b, "idx"))

    @cached_property
    def n(self) -> int:
        """Records of the larger party, blank names included; sets how much of a vector a mask holds."""
        return self.clean.count()

    @cached_property
    def masks(self) -> list[list[int]]:
        return masks(self.n, self.config)

    @property
    def fuzzy(self) -> DataFrame:
        return synth.mutate(self.clean, self.config) if self.noisy is None else self.noisy

    @property
    def records(self) -> DataFrame:
        return names.records_of(self.fuzzy)

    @property
    def encoded(self) -> DataFrame:
        return blocking.encoded(self.records, self.config)

    @property
    def projections(self) -> DataFrame:
        return blocking.projections(self.encoded, self.masks, self.config)

    @property
    def capped(self) -> DataFrame:
        return blocking.capped(self.projections, self.config)

    @property
    def meetings(self) -> DataFrame:
        return blocking.meetings(self.capped)

    @property
    def candidates(self) -> DataFrame:
        return blocking.candidates(self.meetings)

    @property
    def numbered(self) -> DataFrame:
        return blocking.numbered(self.candidates)

    @property
    def matches(self) -> DataFrame:
        return verify.matches(self.candidates, self.encoded, self.config)

    def timed(self, rounds: int | None = None) -> DataFrame:
        """(round, n_matches, seconds): each round matched on its own, on tables that are read once.

        The driver's clock, so other work on the cluster counts.
        """
        enc = self.encoded.persist()
        try:
            enc.count()
            rows = []
            for r in range(self.config.rounds if rounds is None else rounds):
                began = time.perf_counter()
                met = blocking.meetings(blocking.capped(blocking.projections(enc, self.masks, self.config).where(F.col("round") == r), self.config))
                n = verify.matches(blocking.candidates(met), enc, self.config).count()
                rows.append((r, n, time.perf_counter() - began))
            return self.spark.createDataFrame(rows, "round bigint, n_matches bigint, seconds double")
        finally:
            enc.unpersist()

    @property
    def classified(self) -> DataFrame:
        return evaluate.classified(self.matches, self.config)

    @property
    def missed(self) -> DataFrame:
        return evaluate.missed(self.fuzzy, self.matches)

    @property
    def summary(self) -> DataFrame:
        return evaluate.summary(self.classified, self.fuzzy)
