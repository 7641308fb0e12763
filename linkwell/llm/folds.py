"""The fold of a document: crc32 of its doc_id as text, modulo 3."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that no model learns from; a null doc_id is in no fold: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def sampled(rows: DataFrame, doc_id: str, most: int, count: Column) -> DataFrame:
    """The rows of the ``most`` least hashes of their ids and some more: of ``count`` rows, four
    times ``most`` are expected, however many there are."""
    unit = F.conv(F.substring(F.md5(F.col(doc_id).cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return rows.where(unit * count <= 4.0 * most)
