"""Sinks: partitioned tables, standard CSV, and one-row summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwell.config import DEFAULT, LinkageConfig
from linkwell.sources.names import exists, positioned

#: The columns of opened matches in files.
OPENED = ("round", "party0_index", "party0_name", "party1_index", "party1_name", "proj_dist", "payload_dist")
OURS = ("round", "a_idx", "a_name", "b_idx", "b_name", "proj_dist", "payload_dist")


def write_rounds(projected: DataFrame, path: str) -> None:
    """Both parties' projections, a folder for each round and party."""
    projected.repartition("round", "party").write.partitionBy("round", "party").mode("overwrite").parquet(path)


def read_round(spark: SparkSession, path: str, round_: int, party: int | None = None) -> DataFrame:
    """One round, of one party or both: other folders are not read."""
    rows = spark.read.parquet(path).where(F.col("round") == round_)
    return rows if party is None else rows.where(F.col("party") == party)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Header and doubled quotes; columns in a fixed order."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def quoted(text: Column) -> Column:
    """In double quotes; quotes and backslashes with a backslash before them."""
    return F.concat(F.lit('"'), F.regexp_replace(text, '(["\\\\])', "\\\\$1"), F.lit('"'))


def opened_lines(matches: DataFrame) -> DataFrame:
    """(value): matches as lines of a file, names quoted."""
    cells = [quoted(F.col(c)) if c.endswith("_name") else F.col(c).cast("string") for c in OURS]
    return matches.select(F.concat_ws(",", *cells).alias("value"))


def write_opened(matches: DataFrame, path: str) -> None:
    """Files of such lines, a header in each."""
    # a table of one column, with delimiters that no line has: lines stay as they are
    lines = opened_lines(matches).withColumnRenamed("value", ",".join(OPENED))
    plain = {"header": True, "sep": "\x01", "quote": "\x02", "escape": "\x03", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.write.mode("overwrite").options(**plain).csv(path)


def read_opened(spark: SparkSession, path: str) -> DataFrame:
    """Matches of such files, as the matcher has them; names may be quoted with backslashes or doubled quotes,
    or plain. Other lines than headers fail."""
    name = '("(?:[^"\\\\]|\\\\.|"")*"|[^",]*)'
    line = f"^([0-9]+),([0-9]+),{name},([0-9]+),{name},(-?[0-9]+),(-?[0-9]+)$"
    rows = spark.read.text(path).where((F.col("value") != ",".join(OPENED)) & (F.trim("value") != ""))
    value = F.when(F.col("value").rlike(line), F.col("value")).otherwise(F.raise_error(F.lit("not a line of an opened match")))
    cell = lambda i: F.regexp_extract(value, line, i)
    body = lambda x: F.regexp_replace(x, '^"|"$', "")
    told = lambda x: F.when(x.contains("\\"), F.regexp_replace(body(x), "\\\\(.)", "$1")).otherwise(F.replace(body(x), F.lit('""'), F.lit('"')))
    text = lambda x: F.when(x.startswith('"'), told(x)).otherwise(x)
    return rows.select(*[(text(cell(i)) if c.endswith("_name") else cell(i).cast("long")).alias(c) for i, c in enumerate(OURS, 1)])


def preview(df: DataFrame, rows: int = 10) -> tuple[list, int]:
    """The first rows and how many more there are."""
    first = df.limit(rows).collect()
    return first, max(0, df.count() - len(first))


def read_legacy_rounds(spark: SparkSession, path: str) -> DataFrame:
    """(party, idx, name, projection, payload) of a text file with sections #A and #B.

    Lines: index, quoted name, projection and payload, by tabs. The section of a line is
    that of the last header before it in its file.
    """
    lines = positioned(spark.read.text(path).withColumnRenamed("value", "line"), "file")
    section = F.when(F.col("line").startswith("#A"), 0).when(F.col("line").startswith("#B"), 1)
    # a row a file, of its few headers
    headers = lines.where(section.isNotNull()).groupBy(F.col("file").alias("of_file")).agg(F.collect_list(F.struct("idx", section.alias("party"))).alias("headers"))
    rows = lines.where(section.isNull() & (F.trim("line") != "")).join(headers, F.col("file") == F.col("of_file"))
    earlier = F.filter("headers", lambda h: h["idx"] < F.col("idx"))
    rows = rows.withColumn("party", F.array_max(earlier)["party"]).where("party IS NOT NULL")
    cells = F.split("line", "\t")
    name = F.regexp_replace(F.regexp_replace(cells[1], '^"|"$', ""), '\\\\(["\\\\])', "$1")
    return rows.select(F.col("party").cast("long").alias("party"), cells[0].cast("long").alias("idx"), name.alias("name"), cells[2].alias("projection"), cells[3].alias("payload"))


def matched_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; other lines are skipped. Without a file there are no ids."""
    if not exists(spark, path):
        return spark.createDataFrame([], "candidate_id long")
    rows = spark.read.text(path).select(F.trim("value").alias("value")).where(F.col("value").rlike("^[0-9]+$"))
    return rows.select(F.col("value").cast("long").alias("candidate_id")).distinct().orderBy("candidate_id")


def ids_of_logs(spark: SparkSession, path: str) -> DataFrame:
    """The candidate ids that log lines report as matches."""
    found = F.regexp_extract("value", "MATCH candidate_id=([0-9]+)", 1)
    return spark.read.text(path).where(found != "").select(found.cast("long").alias("candidate_id")).distinct().orderBy("candidate_id")


def require_inputs(spark: SparkSession, paths: list[str], candidates: int, config: LinkageConfig = DEFAULT) -> None:
    """Raises unless both parties' files are there and have a flag and all chunks of every candidate, one a line."""
    lost = [p for p in paths if not exists(spark, p)]
    if lost:
        raise FileNotFoundError(f"missing required files: {lost}")
    expected = candidates * (config.bits // config.chunk_bits + 1)
    lines = {p: spark.read.text(p).count() for p in paths}
    if any(n != expected for n in lines.values()):
        raise ValueError(f"input line count mismatch: expected {expected}, got {lines}")


def write_settings(spark: SparkSession, path: str, candidates: int, config: LinkageConfig = DEFAULT, offset: int = 0) -> None:
    """The settings of a batch of candidates as KEY = VALUE lines; ``config`` has checked that chunks fit."""
    values = {
        "PAYLOAD_BITS": config.bits,
        "CHUNK_BITS": config.chunk_bits,
        "PAYLOAD_CHUNKS": config.bits // config.chunk_bits,
        "HAMMING_D": config.threshold,
        "CANDIDATE_OFFSET": offset,
        "MAX_CANDIDATES": candidates,
    }
    lines = spark.createDataFrame([(f"{k} = {v}",) for k, v in values.items()], "value string")
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A row as name: value lines."""
    names = F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in summary.columns])
    summary.select(F.explode(names).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def settings(spark: SparkSession, path: str) -> dict[str, str]:
    """KEY = VALUE lines of a small file."""
    rows = spark.read.text(path).select(F.regexp_extract("value", "^\\s*(\\w+)\\s*=", 1).alias("k"), F.trim(F.regexp_extract("value", "=\\s*(.*)$", 1)).alias("v"))
    return {r.k: r.v for r in rows.where("k <> ''").collect()}
