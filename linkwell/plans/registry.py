"""Every query of the library with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwell.config import DEFAULT
from linkwell.functions import distance, encode, normalize, records, words64
from linkwell.operators import blocking, evaluate, shares, synth, verify
from linkwell.plans import oracle as o
from linkwell.plans.pipeline import Linkage
from linkwell.sources import names, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function of a ``Linkage`` under its name."""

    def add(f: Callable[[Linkage], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Linkage.of(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table_query(sql: str | None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


name = lambda: F.col("name")

# -- scalar functions


@query(o.query("clean", f"SELECT idx, name, {o.folded('name')} AS clean, {o.folded('name', True)} AS hyphenated FROM clean"))
def normalize_name(x: Linkage) -> DataFrame:
    return x.clean.select("idx", "name", normalize.normalize(name()).alias("clean"), normalize.normalize(name(), True).alias("hyphenated"))


@query(o.query("clean", f"SELECT idx, {o.tokens(o.folded('name'))} AS tokens, list_sort(list_distinct(tokens)) AS unique_tokens FROM clean"))
def tokenize(x: Linkage) -> DataFrame:
    rows = x.clean.select("idx", normalize.tokenize(normalize.normalize(name())).alias("tokens"))
    return rows.withColumn("unique_tokens", normalize.sorted_unique(F.col("tokens")))


@query(o.query("clean", f"SELECT idx, {o.tail(o.tokens(o.folded('hyphened', True)))} AS tokens FROM (SELECT idx, regexp_replace(name, ' ', '-') AS hyphened FROM clean)"))
def tail_tokens(x: Linkage) -> DataFrame:
    hyphened = F.regexp_replace("name", "^([^ ]*) ", "$1-")  # the first space, so that there are hyphens
    return x.clean.select("idx", normalize.tail_tokens(normalize.tokenize(normalize.normalize(hyphened, True))).alias("tokens"))


@query(o.query("clean", f"SELECT idx, flatten(list_transform({o.tokens(o.folded('name'))}, lambda t: {o.grams('t', False)})) AS grams FROM clean"))
def qgrams(x: Linkage) -> DataFrame:
    tokens = normalize.tokenize(normalize.normalize(name()))
    return x.clean.select("idx", F.flatten(F.transform(tokens, lambda t: encode.qgrams(encode.pad(t)))).alias("grams"))


@query(o.query("clean", f"SELECT idx, flatten(list_transform({o.tokens(o.folded('name'))}, lambda t: {o.grams('t')})) AS grams FROM clean"))
def canonical_qgrams(x: Linkage) -> DataFrame:
    tokens = normalize.tokenize(normalize.normalize(name()))
    return x.clean.select("idx", F.flatten(F.transform(tokens, lambda t: encode.token_grams(t))).alias("grams"))


@query(o.query("clean", f"SELECT idx, {o.bits(o.tokens(o.folded('name')))} AS bits FROM clean"))
def encode_base(x: Linkage) -> DataFrame:
    return x.clean.select("idx", encode.encode_base(name()).alias("bits"))


@query(o.query("clean", f"SELECT idx, {o.bits(o.tail(o.tokens(o.folded('name', True))))} AS bits FROM clean"))
def encode_tail_token(x: Linkage) -> DataFrame:
    return x.clean.select("idx", encode.encode_tail_token(name()).alias("bits"))


@query(o.query("enc", "SELECT party, idx, name, bits FROM enc"))
def encode_token_or(x: Linkage) -> DataFrame:
    return x.encoded


@query(o.query("clean", f"SELECT idx, {o.evaluated('name')} AS norm, regexp_replace(name, '[{o.SPACE}]', '', 'g') = '' AS blank FROM clean"))
def eval_normalize(x: Linkage) -> DataFrame:
    return x.clean.select("idx", normalize.normalize_for_evaluation(name()).alias("norm"), normalize.is_blank(name()).alias("blank"))


@query(
    o.query(
        "clean",
        f"SELECT idx, array_to_string(list_sort(t), ' ') AS sorted_key, array_to_string(list_sort(list_distinct(t)), ' ') AS unique_key FROM (SELECT idx, {o.tokens(o.evaluated('name'))} AS t FROM clean)",
    )
)
def token_keys(x: Linkage) -> DataFrame:
    return x.clean.select("idx", normalize.sorted_token_key(name()).alias("sorted_key"), normalize.sorted_unique_token_key(name()).alias("unique_key"))


@query(o.query("clean", f"SELECT idx, translate(name, '{normalize.ACCENT_FROM}', '{normalize.ACCENT_TO}') AS plain FROM clean"))
def strip_diacritics(x: Linkage) -> DataFrame:
    return x.clean.select("idx", normalize.strip_diacritics(name()).alias("plain"))


@query(o.query("enc", "SELECT party, idx, array_to_string(list_transform(range(2048), lambda i: CASE WHEN list_contains(bits, i) THEN '1' ELSE '0' END), '') AS text, bits AS back FROM enc"))
def bit_strings(x: Linkage) -> DataFrame:
    rows = x.encoded.select("party", "idx", encode.to_binary_string(F.col("bits"), DEFAULT.bits).alias("text"))
    return rows.withColumn("back", encode.from_binary_string(F.col("text")))


def _texts(chunks: str):
    """Unsigned 64-bit numbers as texts, which any engine compares."""
    return F.transform(chunks, lambda c: c.cast("string")).alias("chunks")


_TEXTS = "list_transform(chunks, lambda c: CAST(c AS VARCHAR)) AS chunks"


@query(o.query("words64", f"SELECT party, idx, {_TEXTS} FROM words64"))
def u64_chunks(x: Linkage) -> DataFrame:
    return x.encoded.select("party", "idx", encode.to_chunks(F.col("bits")).alias("chunks")).withColumn("chunks", _texts("chunks"))


@query(
    o.query(
        "ids enc words64 paired",
        f"SELECT candidate_id, d <= {DEFAULT.threshold} AS is_match, list_transform(chunks, lambda c: CASE WHEN d <= {DEFAULT.threshold} THEN CAST(c AS VARCHAR) ELSE '0' END) AS chunks FROM paired JOIN words64 w ON w.party = 0 AND w.idx = a_idx",
    )
)
def vmask(x: Linkage) -> DataFrame:
    rows = verify.with_payloads(x.numbered, x.encoded).withColumn("is_match", distance.hamming(F.col("a_bits"), F.col("b_bits")) <= DEFAULT.threshold)
    return verify.masked_payloads(rows.select("candidate_id", "is_match", encode.to_chunks(F.col("a_bits")).alias("chunks")), "is_match", "chunks").withColumn("chunks", _texts("chunks"))


# -- blocking


@query(o.query("masks", "SELECT round, bit FROM masks"))
def projection_masks(x: Linkage) -> DataFrame:
    rows = [(r, mask) for r, mask in enumerate(x.masks)]
    return x.spark.createDataFrame(rows, "round bigint, mask array<bigint>").select("round", F.explode("mask").alias("bit"))


@query(o.query("proj", "SELECT round, party, idx, key FROM proj"))
def project_records(x: Linkage) -> DataFrame:
    return x.projections


@query(
    o.query(
        "proj",
        "SELECT round, party, count(*) AS n_buckets, CAST(sum(n) AS BIGINT) AS n_records, max(n) AS max_bucket, max(least(n, 3)) AS max_bucket_capped FROM (SELECT round, party, key, count(*) AS n FROM proj GROUP BY ALL) GROUP BY round, party",
    )
)
def bucket_stats(x: Linkage) -> DataFrame:
    return blocking.bucket_stats(x.projections)


@query(o.query("capped", "SELECT round, party, key_hash, idx, place FROM capped"))
def representative_cap(x: Linkage) -> DataFrame:
    return x.capped.select("round", "party", "key_hash", "idx", "place")


@query(o.query("met", "SELECT round, key_hash, a, b FROM met"))
def bucket_intersections(x: Linkage) -> DataFrame:
    return x.meetings


@query(o.query("expanded", "SELECT round, key_hash, a_idx, b_idx FROM expanded"))
def blocking_join(x: Linkage) -> DataFrame:
    return blocking.expanded(x.meetings)


@query(
    o.query(
        "met cand",
        "SELECT m.round, n_common, n_pairs, coalesce(n_new, 0) AS n_new, n_pairs - coalesce(n_new, 0) AS n_repeated FROM (SELECT round, count(*) AS n_common, CAST(sum(len(a) * len(b)) AS BIGINT) AS n_pairs FROM met GROUP BY round) m "
        "LEFT JOIN (SELECT round, count(*) AS n_new FROM cand GROUP BY round) c ON m.round = c.round",
    )
)
def round_stats(x: Linkage) -> DataFrame:
    return blocking.round_stats(x.meetings)


@query(o.query("cand", "SELECT a_idx, b_idx, round FROM cand"))
def candidate_dedupe(x: Linkage) -> DataFrame:
    return x.candidates


@query(o.query("ids", "SELECT candidate_id, round, a_idx, b_idx FROM ids"))
def candidate_ids(x: Linkage) -> DataFrame:
    return x.numbered


@query(o.query("ids enc", "SELECT candidate_id, round, a_idx, x.name AS a_name, b_idx, y.name AS b_name, CAST(0 AS BIGINT) AS proj_dist FROM ids JOIN enc x ON x.party = 0 AND x.idx = a_idx JOIN enc y ON y.party = 1 AND y.idx = b_idx"))
def candidate_manifest(x: Linkage) -> DataFrame:
    return verify.manifest(x.numbered, x.encoded)


@query(o.query("ids", f"SELECT candidate_id // {DEFAULT.batch_size} AS batch, candidate_id // {DEFAULT.batch_size} * {DEFAULT.batch_size} AS candidate_offset, count(*) AS n FROM ids GROUP BY ALL"))
def batch_slices(x: Linkage) -> DataFrame:
    return verify.batches(x.numbered)


@query(o.query("ids words64", f"SELECT candidate_id, true AS active, {_TEXTS} FROM ids JOIN words64 ON party = 1 AND idx = b_idx"))
def party_inputs(x: Linkage) -> DataFrame:
    return verify.party_inputs(x.numbered, x.encoded, 1).withColumn("chunks", _texts("chunks"))


@query(
    o.query(
        "paired",
        f"SELECT range AS candidate_id, d IS NOT NULL AS active, coalesce(d <= {DEFAULT.threshold}, false) AS is_match "
        f"FROM (SELECT unnest(range((count(*) + {DEFAULT.batch_size - 1}) // {DEFAULT.batch_size} * {DEFAULT.batch_size})) AS range FROM paired) LEFT JOIN paired ON candidate_id = range",
    )
)
def active_slots(x: Linkage) -> DataFrame:
    ids = x.numbered
    slots = -(-ids.count() // DEFAULT.batch_size) * DEFAULT.batch_size  # whole batches
    return verify.revealed_slots(*[verify.party_inputs(ids, x.encoded, p, slots=slots) for p in (0, 1)])


_LE = "(substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))"


def _le32(x: str) -> str:
    return "list_transform([lpad(hex(CAST(" + x + " AS BIGINT)), 8, '0')], lambda h: " + _LE + ")[1]"


_BODY = f"substr(hex(encode(name)), 1, {2 * DEFAULT.name_bytes})"
_VALUE = f"({_le32('idx')} || {_le32(f'length({_BODY}) // 2')} || rpad({_BODY}, {2 * DEFAULT.name_bytes}, '0'))"


@query(o.query("enc", f"SELECT party, idx, {_VALUE} AS value, idx AS back_idx, name AS back_name FROM enc"))
def serialized_values(x: Linkage) -> DataFrame:
    rows = x.encoded.select("party", "idx", records.serialized(F.col("idx"), name()).alias("body"))
    back = records.deserialized(F.col("body"))
    return rows.select("party", "idx", F.hex("body").alias("value"), back["idx"].alias("back_idx"), back["name"].alias("back_name"))


@query(
    o.query(
        "capped enc",
        f"SELECT round, key_hash, {_le32('count(*)')} || rpad(string_agg({_VALUE}, '' ORDER BY place), {2 * (8 + DEFAULT.name_bytes) * DEFAULT.representatives}, '0') AS body, list(idx ORDER BY place) AS ids "
        "FROM capped c JOIN (SELECT party AS p, idx AS i, name FROM enc) ON p = 0 AND i = idx WHERE party = 0 GROUP BY round, key_hash",
    )
)
def sender_buckets(x: Linkage) -> DataFrame:
    rows = blocking.sender_buckets(x.capped, x.encoded).withColumn("back", records.deserialized_bucket(F.col("bucket")))
    return rows.select("round", "key_hash", F.hex("bucket").alias("body"), F.transform("back", lambda v: v["idx"]).alias("ids"))


# -- verification


@query(o.query("matches", f"SELECT *, CAST({DEFAULT.bits} AS BIGINT) AS verified_share_count FROM matches"))
def share_dump(x: Linkage) -> DataFrame:
    return verify.share_dump(x.matches)


@query(o.query("expanded matches", f"SELECT r.range AS round, count(m.a_idx) AS n_matches FROM range({DEFAULT.rounds}) r LEFT JOIN (SELECT e.round, e.a_idx FROM expanded e JOIN matches USING (a_idx, b_idx)) m ON m.round = r.range GROUP BY r.range"))
def round_matches(x: Linkage) -> DataFrame:
    return verify.round_matches(x.meetings, x.matches)


_QUOTED = """'"' || replace(replace({x}, '\\', '\\\\'), '"', '\\"') || '"'"""


@query(o.query("matches", f"SELECT concat_ws(',', round, a_idx, {_QUOTED.format(x='a_name')}, b_idx, {_QUOTED.format(x='b_name')}, proj_dist, payload_dist) AS value FROM matches"))
def opened_lines(x: Linkage) -> DataFrame:
    return sinks.opened_lines(x.matches)

@query(o.query("paired", f"SELECT candidate_id, d AS distance, d <= {DEFAULT.threshold} AS is_match FROM paired"))
def popcount_filter(x: Linkage) -> DataFrame:
    return verify.revealed(x.numbered, x.encoded)


@query(o.query("matches", "SELECT * FROM matches"))
def hamming_filter(x: Linkage) -> DataFrame:
    return x.matches


@query(o.query("matches", "SELECT * FROM matches"))
def linkage_pipeline(x: Linkage) -> DataFrame:
    return x.matches


@query(
    o.query(
        "enc",
        f"SELECT x.idx AS a_idx, y.idx AS b_idx, len(x.bits) + len(y.bits) - 2 * len(list_intersect(x.bits, y.bits)) AS payload_dist FROM enc x, enc y WHERE x.party = 0 AND y.party = 1 AND abs(len(x.bits) - len(y.bits)) <= {DEFAULT.threshold} AND payload_dist <= {DEFAULT.threshold}",
    )
)
def hamming_exact_join(x: Linkage) -> DataFrame:
    return verify.exact_pairs(x.encoded)


@query(o.query("paired", f"SELECT round, a_idx, a_name, b_idx, b_name, CAST(0 AS BIGINT) AS proj_dist, CAST(-1 AS BIGINT) AS payload_dist FROM paired WHERE d <= {DEFAULT.threshold}"))
def manifest_semi_join(x: Linkage) -> DataFrame:
    ids = x.numbered
    return verify.opened(verify.manifest(ids, x.encoded), verify.revealed(ids, x.encoded).where("is_match"))


# -- evaluation


@query(o.query("fuzzy", f"SELECT idx, CASE WHEN levenshtein(a, b) > 2 THEN 3 ELSE levenshtein(a, b) END AS edit FROM (SELECT idx, {o.evaluated('name')} AS a, {o.evaluated('fuzzy_name')} AS b FROM fuzzy)"))
def levenshtein_pairs(x: Linkage) -> DataFrame:
    norm = normalize.normalize_for_evaluation
    return x.fuzzy.select("idx", distance.bounded_levenshtein(norm(F.col("name")), norm(F.col("fuzzy_name")), 2).cast("long").alias("edit"))


@query(o.query("fuzzy", f"SELECT idx, len(list_distinct(a)) >= 2 AND len(list_distinct(b)) >= 2 AND (list_has_all(a, b) OR list_has_all(b, a)) AS subset FROM (SELECT idx, {o.tokens(o.evaluated('name'))} AS a, {o.tokens(o.evaluated('fuzzy_name'))} AS b FROM fuzzy)"))
def token_subset(x: Linkage) -> DataFrame:
    tokens = normalize.evaluation_tokens
    return x.fuzzy.select("idx", distance.subset_relation(tokens(F.col("name")), tokens(F.col("fuzzy_name"))).alias("subset"))


@query(o.query("classified near_pairs", "SELECT a_idx, b_idx FROM near_pairs"))
def near_token(x: Linkage) -> DataFrame:
    rows = evaluate.enriched(x.matches).where("a_idx <> b_idx")
    return rows.where(distance.near_token_match(F.col("a_tokens"), F.col("b_tokens"))).select("a_idx", "b_idx")


@query(o.query("classified", "SELECT * FROM classified"))
def classify(x: Linkage) -> DataFrame:
    return x.classified


@query(o.query("classified", "SELECT * FROM classified WHERE reason = 'index_match'"))
def true_positives(x: Linkage) -> DataFrame:
    return evaluate.true_positives(x.classified)


@query(o.query("classified", "SELECT * FROM classified WHERE reason NOT IN ('index_match', 'possible_false_positive')"))
def equivalent_duplicates(x: Linkage) -> DataFrame:
    return evaluate.equivalent_duplicates(x.classified)


@query(o.query("classified", "SELECT * FROM classified WHERE reason = 'possible_false_positive'"))
def false_positives(x: Linkage) -> DataFrame:
    return evaluate.false_positives(x.classified)


@query(o.query("missed", "SELECT * FROM missed"))
def missed_true_matches(x: Linkage) -> DataFrame:
    return x.missed


@query(o.query("matches", "SELECT max(greatest(a_idx, b_idx)) + 1 AS n_records FROM matches"))
def default_records(x: Linkage) -> DataFrame:
    return evaluate.default_n(x.matches)


@query(
    o.query(
        "missed matches",
        "SELECT m.idx, 'N' || lpad(CAST(m.idx + 1 AS VARCHAR), 8, '0') AS record_id, clean_name, m.fuzzy_name, clean_name AS original_name, m.error_type, m.is_noisy, clean_norm, fuzzy_norm, clean_sorted_key, fuzzy_sorted_key "
        "FROM missed m WHERE m.idx <= (SELECT max(greatest(a_idx, b_idx)) FROM matches)",
    )
)
def missed_of_files(x: Linkage) -> DataFrame:
    clean = x.clean.select("idx", "name", names.record_id_of(F.col("idx")).alias("record_id"))
    fuzzy = x.fuzzy.select("idx", "fuzzy_name", F.col("name").alias("original_name"), "error_type", "is_noisy")
    return evaluate.missed_of_files(clean, fuzzy, x.matches)


_RATIO = "coalesce(round({a} / nullif({b}, 0), 6), 0)"
_HARMONIC = "coalesce(round(2 * {p} * {r} / nullif({p} + {r}, 0), 6), 0)"


@query(
    o.query(
        "classified expected",
        f"""SELECT evaluated_records, opened_candidate_pairs, true_positives, equivalent_duplicates, possible_false_positives, missed_true_matches, valid_expected_records,
      coalesce(round(p, 6), 0) AS strict_precision, coalesce(round(r, 6), 0) AS strict_recall, {_HARMONIC.format(p='p', r='r')} AS strict_f1,
      coalesce(round(q, 6), 0) AS adjusted_precision, {_HARMONIC.format(p='q', r='r')} AS adjusted_f1,
      {_RATIO.format(a='(possible_false_positives + equivalent_duplicates)::DOUBLE', b='opened_candidate_pairs')} AS strict_false_discovery_rate,
      {_RATIO.format(a='possible_false_positives::DOUBLE', b='opened_candidate_pairs')} AS possible_false_discovery_rate,
      {_RATIO.format(a='missed_true_matches::DOUBLE', b='valid_expected_records')} AS false_negative_rate
    FROM (SELECT *, valid_expected_records - hit AS missed_true_matches, true_positives::DOUBLE / nullif(opened_candidate_pairs, 0) AS p, true_positives::DOUBLE / nullif(valid_expected_records, 0) AS r,
        (true_positives + equivalent_duplicates)::DOUBLE / nullif(opened_candidate_pairs, 0) AS q
      FROM (SELECT count(*) AS opened_candidate_pairs, count(*) FILTER (reason = 'index_match') AS true_positives, count(*) FILTER (reason NOT IN ('index_match', 'possible_false_positive')) AS equivalent_duplicates,
          count(*) FILTER (reason = 'possible_false_positive') AS possible_false_positives, count(DISTINCT a_idx) FILTER (reason = 'index_match') AS hit,
          (SELECT count(*) FROM expected) AS valid_expected_records, (SELECT count(*) FROM fuzzy) AS evaluated_records FROM classified))""",
    )
)
def eval_summary(x: Linkage) -> DataFrame:
    return x.summary


# -- synthesis


@query(o.query("fuzzy", "SELECT idx, name, fuzzy_name, error_type, is_noisy FROM fuzzy"))
def mutate_names(x: Linkage) -> DataFrame:
    return x.fuzzy


@query(o.query("fuzzy", "SELECT error_type, count(*) AS n FROM fuzzy GROUP BY error_type"))
def error_type_counts(x: Linkage) -> DataFrame:
    return synth.error_types(x.fuzzy)


@query(o.query("clean", f"SELECT idx, name FROM clean WHERE idx < {DEFAULT.row_limit // 4}"))
def row_limit(x: Linkage) -> DataFrame:
    return names.limited(x.clean, DEFAULT.row_limit // 4)


@query(o.query("clean", "SELECT idx, name || ' É' AS fixed FROM clean"))
def undo_mojibake(x: Linkage) -> DataFrame:
    broken = F.decode(F.encode(F.concat("name", F.lit(" É")), "UTF-8"), "ISO-8859-1")
    return x.clean.select("idx", normalize.fix_mojibake(broken).alias("fixed"))


@query(o.query("enc", "SELECT party, idx, array_to_string(list_transform(range(256), lambda c: lpad(hex(CAST(list_sum(list_prepend(0, list_transform(list_filter(bits, lambda b: b // 8 = c), lambda b: CAST(pow(2, b % 8) AS INTEGER)))) AS BIGINT)), 2, '0')), '') AS packed, bits AS back FROM enc"))
def packed_bytes(x: Linkage) -> DataFrame:
    rows = x.encoded.select("party", "idx", encode.pack_bytes(F.col("bits"), DEFAULT.bits).alias("body"))
    return rows.select("party", "idx", F.hex("body").alias("packed"), encode.unpack_bytes(F.col("body"), DEFAULT.bits).alias("back"))


@table_query("SELECT n_name AS country, c_name AS localised_name, c_mktsegment AS romanised_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0")
def names_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    # headers as lists have them, cells with spaces, and some without a name
    named = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit(" "), F.col("c_name")))
    return names.names_by_country(rows.select(F.col("n_name").alias("Country"), named.alias(" Localized Name"), F.col("c_mktsegment").alias("ROMANISED NAME"), "c_acctbal"))


@query(o.query("clean", "SELECT idx, 'N' || lpad(CAST(idx + 1 AS VARCHAR), 8, '0') AS record_id, idx AS back FROM clean"))
def record_ids(x: Linkage) -> DataFrame:
    rows = x.clean.select("idx", names.record_id_of(F.col("idx")).alias("record_id"))
    return rows.withColumn("back", names.index_of(F.col("record_id")))


FULL_NAMES = 10_000


@table_query(
    f"""WITH s AS (SELECT n_name AS country, c_name AS surname, row_number() OVER (PARTITION BY n_name ORDER BY c_name) - 1 AS surname_no FROM customer JOIN nation ON c_nationkey = n_nationkey),
    f AS (SELECT n_name AS country, s_name AS forename, row_number() OVER (PARTITION BY n_name ORDER BY s_name) - 1 AS forename_no FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    sizes AS (SELECT *, sum(n_s * n_f) OVER (ORDER BY country) AS high, high - n_s * n_f AS low FROM (SELECT country, count(*) AS n_s FROM s GROUP BY country) JOIN (SELECT country, count(*) AS n_f FROM f GROUP BY country) USING (country)),
    draws AS (SELECT range AS idx, {o.unit("'draw'", str(DEFAULT.seed), 'range')} % (SELECT max(high) FROM sizes) AS at_ FROM range({FULL_NAMES})),
    drawn AS (SELECT idx, country, (at_ - low) // n_f AS surname_no, (at_ - low) % n_f AS forename_no, {o.unit("'middle'", str(DEFAULT.seed), 'idx')} % n_f AS middle_no,
      {o.unit("'has_middle'", str(DEFAULT.seed), 'idx')} / 4294967296.0::DOUBLE < {DEFAULT.middle_name_rate}::DOUBLE AS is_middle FROM draws JOIN sizes ON at_ >= low AND at_ < high)
    SELECT idx, 'N' || lpad(CAST(idx + 1 AS VARCHAR), 8, '0') AS record_id, country, f.forename || ' ' || CASE WHEN is_middle THEN m.forename ELSE '' END || ' ' || surname AS full_name, is_middle
    FROM drawn JOIN s USING (country, surname_no) JOIN f USING (country, forename_no) JOIN f m ON m.country = drawn.country AND m.forename_no = middle_no"""
)
def clean_names_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    by_country = lambda t, key, n: spark.read.parquet(f"{sf_dir}/{t}.parquet").join(nation, F.col(key) == F.col("n_nationkey")).select(F.col("n_name").alias("country"), F.col(n).alias("name"))
    return synth.sampled_full_names(by_country("customer", "c_nationkey", "c_name"), by_country("supplier", "s_nationkey", "s_name"), FULL_NAMES)


# -- shares

_M = "18446744073709551616::UHUGEINT"


def _share_sql(select: str) -> str:
    """Unsigned arithmetic in wide integers, one named step for each line of the tag; products in 32-bit halves."""
    times = lambda x, m: f"((({x} % 4294967296) * ({m & 0xFFFFFFFF}::UHUGEINT) + ((({x} // 4294967296) * ({m & 0xFFFFFFFF}::UHUGEINT) + ({x} % 4294967296) * ({m >> 32}::UHUGEINT)) % 4294967296) * 4294967296) % {_M})"
    key = shares.MASTER_KEY
    return f"""WITH base AS (SELECT o_orderkey AS id, CAST(o_orderkey % 30 AS UHUGEINT) AS round, CAST(o_orderkey * 7919 + o_custkey AS UHUGEINT) AS secret FROM orders),
    valued AS (SELECT id, round, secret, k AS key_id, xor(round * 4294967296::UHUGEINT, {shares.SHARE_MASK}::UHUGEINT) AS r, CASE WHEN k = 0 THEN r ELSE (secret + {_M} - r) % {_M} END AS v FROM base, (SELECT unnest([0, 1]) AS k)),
    m0 AS (SELECT *, xor(xor(v, {key}::UHUGEINT), xor(round, key_id::UHUGEINT)) AS x FROM valued),
    m1 AS (SELECT * REPLACE (xor(x, x // 8589934592) AS x) FROM m0),
    m2 AS (SELECT * REPLACE ({times('x', shares.MIX_1)} AS x) FROM m1),
    m3 AS (SELECT * REPLACE (xor(x, x // 8589934592) AS x) FROM m2),
    m4 AS (SELECT * REPLACE ({times('x', shares.MIX_2)} AS x) FROM m3),
    m5 AS (SELECT * REPLACE (xor(x, x // 8589934592) AS x) FROM m4),
    tagged AS (SELECT id, round, secret, key_id, v, x AS mac FROM m5),
    pairs AS (SELECT a.id, a.round, a.secret, a.v AS v0, a.mac AS mac0, b.v AS v1, b.mac AS mac1 FROM tagged a JOIN tagged b ON a.id = b.id AND a.key_id = 0 AND b.key_id = 1)
    {select}"""


def _signed(x: str) -> str:
    return f"CAST(CASE WHEN {x} >= 9223372036854775808 THEN CAST({x} AS HUGEINT) - 18446744073709551616::HUGEINT ELSE CAST({x} AS HUGEINT) END AS BIGINT)"


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    base = orders.select(F.col("o_orderkey").cast("long").alias("id"), (F.col("o_orderkey") % 30).cast("long").alias("round"), (F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("long").alias("secret"))
    return shares.share(base, "secret", "round")


@table_query(_share_sql(f"SELECT id, {_signed('v0')} AS s0_value, {_signed('mac0')} AS s0_mac, {_signed('v1')} AS s1_value, {_signed('mac1')} AS s1_mac, CAST((v0 + v1) % {_M} AS BIGINT) AS opened FROM pairs"))
def share_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shared(spark, sf_dir)
    return rows.select("id", "s0_value", "s0_mac", "s1_value", "s1_mac", shares.reconstructed(F.col("s0_value"), F.col("s1_value")).alias("opened"))


@table_query(_share_sql("SELECT id, true AS verified, false AS verified_in_next_round FROM pairs"))
def share_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shared(spark, sf_dir)
    valid = lambda i, r: shares.verified(F.col(f"s{i}_value"), F.col(f"s{i}_mac"), F.col(f"s{i}_key_id"), r)
    now, later = F.col("round"), F.col("round") + 1
    return rows.select("id", (valid(0, now) & valid(1, now)).alias("verified"), (valid(0, later) | valid(1, later)).alias("verified_in_next_round"))


@table_query(_share_sql("SELECT id, false AS value_passes, mac0 = 0 AS mac_passes, false AS key_passes FROM pairs"))
def share_tamper(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shared(spark, sf_dir)
    value, tag, key, round_ = (F.col(c) for c in ("s0_value", "s0_mac", "s0_key_id", "round"))
    one = words64.literal(1)
    return rows.select(
        "id",
        shares.verified(words64.xor(value, one), tag, key, round_).alias("value_passes"),
        shares.verified(value, words64.literal(0), key, round_).alias("mac_passes"),
        shares.verified(value, tag, F.lit(9).cast("long"), round_).alias("key_passes"),
    )


@table_query(_share_sql(f"SELECT id, {_signed(f'((v0 + v0) % {_M})')} AS sum_value, true AS verified FROM pairs"))
def share_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shares.added(_shared(spark, sf_dir), "s0", "s0", "sum", "round")
    return rows.select("id", "sum_value", shares.verified(F.col("sum_value"), F.col("sum_mac"), F.col("sum_key_id"), F.col("round")).alias("verified"))


@query(o.query("proj", "SELECT round, party, idx, true AS holds, len(projected) > 0 AS altered_is_found FROM proj"))
def rlc_check(x: Linkage) -> DataFrame:
    member = encode.membership(x.masks)
    rounds = F.sequence(F.lit(0), F.lit(DEFAULT.rounds - 1))
    rows = x.encoded.select("party", "idx", "bits", F.posexplode(F.transform(rounds, lambda r: encode.project(F.col("bits"), member, r))).alias("round", "projected"))
    rows = rows.withColumn("round", F.col("round").cast("long"))
    drop_last = F.slice("projected", F.lit(1), F.greatest(F.size("projected") - 1, F.lit(0)))
    good = shares.checked_projections(rows, x.masks).select("round", "party", "idx", (F.col("sum_projected") == F.col("sum_original")).alias("holds"))
    altered = shares.checked_projections(rows.withColumn("projected", drop_last), x.masks)
    altered = altered.select("round", "party", "idx", (F.col("sum_projected") != F.col("sum_original")).alias("altered_is_found"))
    return good.join(altered, ["round", "party", "idx"])
