"""The queries of this subpackage: one opN_<name> per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwell.llm import decontaminate, jaccard, language, licences, media, mixing, quality, repeats, secrets, sharding
from linkwell.llm.runtime import documents


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(documents(spark, sf_dir), k=4, percent=85).select("doc_id", "n_shingles", "component_id", "n_links")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    store = sharding.shard(docs)
    rows = store.read(docs.schema)
    shard, n_rows, tier = rows.columns[-3:]
    return rows.select("doc_id", F.col(shard).alias("shard"), F.col(n_rows).alias("shard_rows"), F.col(tier).alias("tier"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op6_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir)).drop("row_id", "body")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(documents(spark, sf_dir), with_text=False).drop("kept")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("row_id", "text_key", "item_no")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, totals = mixing.mix(documents(spark, sf_dir))
    return totals.select("doc_id", "size", "source_size", "target", "taken")


#: Words of a text: runs of characters other than space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"

ORACLE_JACCARD = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i : i + 3]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS shingle
  FROM worded
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), edges AS (
  SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links
), reached AS (
  SELECT u, u AS v FROM edges UNION SELECT r.u, e.v FROM reached r JOIN edges e ON r.v = e.u
), least_of AS (
  SELECT u, min(v) AS m FROM reached GROUP BY u
), degrees AS (
  SELECT u AS d, count(*) AS n_links FROM edges GROUP BY u
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(n_links, 0) AS n_links
FROM worded LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON u = doc_id LEFT JOIN degrees ON d = doc_id
"""

ORACLE_REPEATS = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, length(x) // 2 AS n FROM documents
), windows AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS w FROM (SELECT doc_id, x, unnest(range(greatest(n - 399, 0))) AS i FROM bytes)
), repeated AS (
  SELECT doc_id, i FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)
), marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS first FROM repeated
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked) GROUP BY doc_id, span
), kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(gap, '' ORDER BY a) AS gaps
  FROM (SELECT s.*, substr(x, 2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0))) AS gap FROM spans s JOIN bytes USING (doc_id))
  GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(gaps, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM bytes LEFT JOIN kept USING (doc_id)
"""

ORACLE_MIXING = f"""
WITH docs AS (
  SELECT doc_id, source, md5(concat_ws(' ', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS ord, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS source_no, 1.5 * sum(source_size) OVER () AS total FROM sizes
), weighed AS (
  SELECT *, CAST([3, 1, 2][CAST(source_no % 3 + 1 AS INT)] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM numbered
), levels AS (
  SELECT *, cap / weight AS fills_at,
    (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, source_no,
    CAST(least(cap, coalesce(arg_min(level, fills_at) FILTER (level < fills_at) OVER (), 'infinity'::DOUBLE) * weight) AS DOUBLE) AS target
  FROM levels
), placed AS (
  SELECT doc_id, size, t.source_size, target,
    coalesce(sum(size) OVER (PARTITION BY source_no ORDER BY ord, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), spans AS (
  SELECT *, start + e.range * source_size AS first FROM placed, range(2) e
)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(first + size, CAST(round(target) AS BIGINT)) - first)) AS BIGINT) AS taken
FROM spans GROUP BY doc_id, size, source_size, target, start
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_quality_classifier,
        op3_secret_scans,
        op4_sharding,
        op5_language_id,
        op6_licence_scans,
        op7_suffix_array_dedup,
        op8_media_columns,
        op9_benchmark_decontamination,
        op10_mixing,
    )
}
ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": ORACLE_JACCARD, "op7_suffix_array_dedup": ORACLE_REPEATS, "op10_mixing": ORACLE_MIXING}
