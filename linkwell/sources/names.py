"""Name tables: CSV, Parquet and literal scans, and records keyed by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkwell.functions.normalize import is_blank

#: Pairs of hard cases; equal positions are meant to match but for 14 to 18.
LITERAL_NAMES = (
    ("ALEXANDER-SMITH JONATHAN", "JONATHAN ALEXANDER SMITH"),
    ("LEE CHING WAI", "CHING WAI LEE"),
    ("SIMON BARON-COHEN", "SIMON COHEN"),
    ("GARCIA-LORENZ MARIA ELENA", "MARIA ELENA GARCIA LORENZ"),
    ("ABDUL RAHMAN BIN AZIZ", "AZIZ ABDUL RAHMAN"),
    ("CATHERINE ZETA-JONES", "KATHERINE ZETA JONES"),
    ("MUHAMMAD AL-FARISI", "MOHAMMAD AL FARISI"),
    ("ELIZABETH HIGGINS", "ELISABETH HIGGINS"),
    ("NICHOLAS BROOKS", "NICKOLAS BROOKS"),
    ("WILLIAM ROBERT THORNTON", "WM ROBERT THORNTON"),
    ("CHRISTOPHER P. LOWE", "CHRISTOPHER PAUL LOWE"),
    ("SOPHIA ISABELLA RODRIGUEZ", "SOPHIA I. RODRIGUEZ"),
    ("LIAN WEI", "LIAN  WEI"),
    ("O'CONNOR SHAUN", "OCONNOR SHAUN"),
    ("JONATHAN SMITH", "JENNIFER SMITH"),
    ("LI WEI MING", "LI WEI KANG"),
    ("BENJAMIN FRANKLIN", "BEN F"),
    ("DAISY MILLER", "THOMAS ANDERSON"),
    ("PETER PARKER", "BRUCE WAYNE"),
)
#: Headers that name lists by country may have.
HEADERS = {
    "country": "country",
    "localised name": "localised_name",
    "localized name": "localised_name",
    "romanised name": "romanised_name",
    "romanized name": "romanised_name",
}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def resolve(spark: SparkSession, path: str) -> str:
    """``path``, or the same under the parent folder; raises if neither exists."""
    for candidate in (path, f"../{path}"):
        if exists(spark, candidate):
            return candidate
    raise FileNotFoundError(path)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Header row, doubled quotes, no line breaks in cells, strings only; too short or long rows fail."""
    rows = (
        spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").option("encoding", "UTF-8").csv(resolve(spark, path))
    )
    missing = set(columns or []) - set(rows.columns)
    if missing:
        raise ValueError(f"CSV column not found: {sorted(missing)}")
    return rows.select(*columns) if columns else rows


def positioned(rows: DataFrame, file_column: str | None = None) -> DataFrame:
    """``rows`` as read from files, with ``idx``: their positions from 0, in the order of files and lines;
    and with the file of each in ``file_column``.

    Rows count on within their piece of a file, after the counts of the pieces before it.
    """
    file = rows.metadataColumn("_metadata")
    at = ["lw_file", "lw_block"]
    rows = rows.select("*", file["file_path"].alias(at[0]), file["file_block_start"].alias(at[1]), F.monotonically_increasing_id().alias("lw_row"))
    pieces = rows.groupBy(*at).agg(F.count("*").alias("n"), F.min("lw_row").alias("lw_first"))  # a row a piece
    earlier = Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("lw_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    rows = rows.join(F.broadcast(pieces), at)
    rows = rows.withColumn("idx", F.col("lw_before") + F.col("lw_row") - F.col("lw_first"))
    rows = rows.withColumn(file_column, F.col(at[0])) if file_column else rows
    return rows.drop(*at, "lw_row", "lw_first", "lw_before")


def limited(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` positions of (idx, ...); 0 is no limit. Blank names count."""
    return rows.where(F.col("idx") < limit) if limit else rows


def read_names(spark: SparkSession, path: str, column: str, limit: int = 0) -> DataFrame:
    """(idx, name) of a CSV column, in file order, blank lines skipped."""
    rows = positioned(read_csv(spark, path, None)).select("idx", F.coalesce(column, F.lit("")).alias("name"))
    return limited(rows, limit)


def literal_names(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The two sides of the literal pairs as (idx, name)."""
    return tuple(spark.createDataFrame([(i, p[side]) for i, p in enumerate(LITERAL_NAMES)], "idx bigint, name string") for side in (0, 1))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` as scanned, dealt out anew if the scan has fewer splits than there are cores.

    A small file can be one split, and all that follows a scan without a shuffle would run in its
    one task. Large tables have more splits than cores and stay as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def index_of(record_id: Column) -> Column:
    """The position from 0 that an id such as N00000001 stands for."""
    return F.substring(record_id, 2, 20).cast("long") - 1


def record_id_of(index: Column) -> Column:
    return F.format_string("N%08d", index + 1)


def names_by_country(rows: DataFrame) -> DataFrame:
    """Headers made uniform, required columns checked, cells trimmed, rows without names dropped."""
    renamed = rows.withColumnsRenamed({c: HEADERS.get(c.strip().lower(), c.strip().lower().replace(" ", "_")) for c in rows.columns})
    required = ["country", "localised_name", "romanised_name"]
    missing = sorted(set(required) - set(renamed.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    trimmed = renamed.select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in required])
    return trimmed.where((F.col("localised_name") != "") & (F.col("romanised_name") != ""))


def document_names(docs: DataFrame) -> DataFrame:
    """(idx, name): names made of the words at a quarter, half and three quarters of each whole text."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \\n.,!?;:]+"), F.lit(0))
    rows = spread(docs.select("doc_id", "text")).select(F.col("doc_id").alias("idx"), words.alias("words")).withColumn("n", F.size("words"))
    at = lambda part: F.get("words", F.expr(f"(n * {part}) div 4").cast("int"))
    name = F.when(F.col("n") > 0, F.concat_ws(" ", at(1), at(2), at(3))).otherwise("")
    # opened from an array, so that later filters on the name do not parse the text again
    return rows.select("idx", F.inline(F.array(F.struct(name.alias("name")))))


def records(party0: DataFrame, party1: DataFrame) -> DataFrame:
    """(party, idx, name, valid) of two (idx, name) tables; blank names keep their position."""
    both = party0.select(F.lit(0).cast("long").alias("party"), "idx", "name").unionByName(party1.select(F.lit(1).cast("long").alias("party"), "idx", "name"))
    return both.select("party", "idx", F.coalesce("name", F.lit("")).alias("name"), (~is_blank(F.col("name"))).alias("valid"))


def records_of(pairs: DataFrame) -> DataFrame:
    """The same of one table (idx, name, fuzzy_name) that holds both sides: one pass."""
    both = F.array(*[F.struct(F.lit(p).cast("long").alias("party"), F.coalesce(c, F.lit("")).alias("name")) for p, c in enumerate(("name", "fuzzy_name"))])
    rows = pairs.select("idx", F.inline(both))
    return rows.select("party", "idx", "name", (~is_blank(F.col("name"))).alias("valid"))
