import random

import duckdb
import pytest
from pyspark.sql import functions as F

from linkwell.config import DEFAULT, LinkageConfig
from linkwell.functions import encode
from linkwell.operators import blocking, evaluate, synth, verify
from linkwell.plans import registry
from linkwell.plans.pipeline import Linkage
from linkwell.sources import names, sinks

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = registry.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    want = con.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    rows = sorted(map(str, (tuple(str(x) for x in r) for r in got.select(*columns).collect())))
    other = sorted(map(str, (tuple(str(x) for x in r) for r in want.select(*map(duckdb.ColumnExpression, columns)).fetchall())))
    assert rows == other


@pytest.fixture(scope="module")
def linkage(spark, small):
    return Linkage.of(spark, small)


def test_masks_are_of_the_expected_size(linkage):
    p = linkage.config.inclusion(linkage.n)
    assert len(linkage.masks) == 30
    assert all(0.5 * 2048 * p < len(m) < 1.5 * 2048 * p and m == sorted(m) for m in linkage.masks)


def test_invariants_of_blocking(linkage):
    assert linkage.capped.groupBy("round", "party", "key_hash").count().agg(F.max("count")).first()[0] <= 3
    pairs = linkage.candidates
    assert pairs.count() == pairs.select("a_idx", "b_idx").distinct().count()
    stats = blocking.round_stats(linkage.meetings).agg(F.sum("n_pairs"), F.sum("n_new"), F.sum("n_repeated")).first()
    assert stats[0] == stats[1] + stats[2] and stats[1] == pairs.count()
    ids = [r.candidate_id for r in linkage.numbered.select("candidate_id").collect()]
    assert sorted(ids) == list(range(len(ids)))


def test_quality_is_as_expected(linkage):
    s = linkage.summary.first()
    assert s.strict_recall > 0.8 and s.adjusted_precision > 0.9
    assert s.true_positives + s.equivalent_duplicates + s.possible_false_positives == s.opened_candidate_pairs


def test_blocking_loses_little(linkage):
    exact = verify.exact_pairs(linkage.encoded)
    found = linkage.matches.select("a_idx", "b_idx")
    assert found.join(exact, ["a_idx", "b_idx"], "left_anti").count() == 0
    assert found.count() >= 0.85 * exact.count()


def test_no_matches_still_have_a_summary(spark):
    clean = spark.createDataFrame([(0, "AB CD"), (1, ""), (2, None)], "idx bigint, name string")
    fuzzy = clean.withColumn("fuzzy_name", F.lit("XY ZW")).withColumn("error_type", F.lit("none")).withColumn("is_noisy", F.lit(False))
    recs = names.records(clean, fuzzy.select("idx", F.col("fuzzy_name").alias("name")))
    enc, pairs = blocking.candidate_pairs(recs, 3)
    rows = evaluate.classified(verify.matches(pairs, enc))
    s = evaluate.summary(rows, fuzzy).first()
    assert (s.evaluated_records, s.valid_expected_records, s.missed_true_matches, s.strict_precision, s.false_negative_rate) == (3, 1, 1, 0.0, 1.0)
    assert evaluate.missed(fuzzy, rows).count() == 1


def test_reasons(spark):
    cases = [
        (0, 0, "A", "B", "index_match"),
        (0, 1, "Hannah  Schmidt", "HANNAH SCHMIDT", "exact_normalised_name"),
        (0, 1, "JULEN ANE GUTIERREZ", "GUTIERREZ JULEN ANE", "token_order_equivalent"),
        (0, 1, "THOMAS THOMAS BROWN", "THOMAS BROWN", "duplicate_token_equivalent"),
        (0, 1, "EMINE AZRA DEMIR", "EMINE DEMIR", "missing_or_extra_token"),
        (0, 1, "Gilli  Johansen", "Gilli  Johansef", "near_token_edit_distance_le_1"),
        (0, 1, "JONATHAN SMITH", "JENNIFER SMITH", "possible_false_positive"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "round int, a_idx bigint, b_idx bigint, a_name string, b_name string, want string")
    assert [r.reason == r.want for r in evaluate.classified(rows).collect()] == [True] * len(cases)


def test_noise(spark, linkage):
    fuzzy = linkage.fuzzy.collect()
    assert {r.error_type for r in fuzzy} <= {*synth.OPERATIONS, synth.FALLBACK, synth.NONE}
    assert all((r.error_type == "none") == (not r.is_noisy) for r in fuzzy)
    assert all(r.fuzzy_name == r.name for r in fuzzy if not r.is_noisy)
    share = sum(r.is_noisy for r in fuzzy) / len(fuzzy)
    assert 0.75 < share < 0.95
    again = linkage.fuzzy.collect()
    assert again == fuzzy
    blank = synth.mutate(spark.createDataFrame([(1, ""), (2, None), (3, "12"), (4, "x")], "idx bigint, name string")).collect()
    assert [r.error_type for r in blank[:3]] == ["none"] * 3


def test_files(spark, tmp_path, linkage):
    path = str(tmp_path / "rounds")
    sinks.write_rounds(linkage.projections.where("round < 2"), path)
    one = sinks.read_round(spark, path, 1, 0)
    assert one.count() == linkage.projections.where("round = 1 AND party = 0").count()
    assert "PartitionFilters: [isnotnull" in one._jdf.queryExecution().toString()
    table = spark.createDataFrame([(1, 'say "hi", x'), (2, None)], "id int, name string")
    sinks.write_csv(table, str(tmp_path / "csv"), ["id", "name"])
    back = names.read_csv(spark, str(tmp_path / "csv"), ["name", "id"])
    assert sorted((r.id, r.name) for r in back.collect()) == [("1", 'say "hi", x'), ("2", None)]
    with pytest.raises(ValueError, match="not found"):
        names.read_csv(spark, str(tmp_path / "csv"), ["other"])
    with pytest.raises(FileNotFoundError):
        names.read_csv(spark, str(tmp_path / "none"))
    (tmp_path / "log").write_text("x MATCH candidate_id=12\nMATCH candidate_id=3\nMATCH candidate_id=12\nother\n")
    assert [r.candidate_id for r in sinks.ids_of_logs(spark, str(tmp_path / "log")).collect()] == [3, 12]
    (tmp_path / "ids").write_text("7\n\n5\n7\n")
    assert [r.candidate_id for r in sinks.matched_ids(spark, str(tmp_path / "ids")).collect()] == [5, 7]
    (tmp_path / "conf").write_text("HAMMING_D = 4\nCHUNK_BITS=64\n")
    assert sinks.settings(spark, str(tmp_path / "conf")) == {"HAMMING_D": "4", "CHUNK_BITS": "64"}
    (tmp_path / "round.txt").write_text('#A\n0\t"O\\"X"\t01\t0101\n\n#B\n5\t"Y"\t11\t1111\n')
    rows = sinks.read_legacy_rounds(spark, str(tmp_path / "round.txt")).orderBy("party").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 'O"X', "01", "0101"), (1, 5, "Y", "11", "1111")]
    assert sinks.preview(spark.range(15))[1] == 5


def test_names_by_country(spark):
    rows = spark.createDataFrame([(" ES ", "Nuño", "Nuno", "x"), ("FR", "", "A", "y")], ["Country", "Localized Name", "Romanised Name", "Other"])
    assert [tuple(r) for r in names.names_by_country(rows).collect()] == [("ES", "Nuño", "Nuno")]
    with pytest.raises(ValueError, match="romanised_name"):
        names.names_by_country(rows.drop("Romanised Name"))


def test_literal_names_match_end_to_end(spark):
    a, b = names.literal_names(spark)
    enc = blocking.encoded(names.records(a, b), kind="murmur")
    pairs = verify.exact_pairs(enc)
    same = {r.a_idx for r in pairs.collect() if r.a_idx == r.b_idx}
    assert same == {0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 13}


def test_stream_equals_batch(spark, tmp_path, linkage):
    from linkwell.streaming import matching

    clean = linkage.clean.where("idx < 60")
    matching.known_blocks(clean, linkage.masks).write.parquet(str(tmp_path / "blocks"))
    arrivals = linkage.fuzzy.where("idx < 60").select("idx", F.col("fuzzy_name").alias("name"))
    arrivals.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("idx bigint, name string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = matching.match_stream(stream, spark.read.parquet(str(tmp_path / "blocks")), linkage.masks, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {(r.a_idx, r.b_idx) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    enc, pairs = blocking.candidate_pairs(names.records(clean, arrivals), linkage.n)
    assert got == {(r.a_idx, r.b_idx) for r in verify.matches(pairs, enc).collect()}
    hot = spark.createDataFrame([(i, "ONE NAME") for i in range(50)], "idx bigint, name string")
    assert matching.known_blocks(hot, linkage.masks).groupBy("round", "key_hash").count().agg(F.max("count")).first()[0] == 3
    assert encode.hash_unit_of("a", 1) < 1 << 32


#: Published pairs with their distances and reasons; hash collisions show in the first four.
PUBLISHED = [
    ("Lucas  Moreno", "Lucas  Mtreno", 3, "near_token_edit_distance_le_1"),
    ("Grace  Rose", "Grace  Rpse", 3, "near_token_edit_distance_le_1"),
    ("Haruna  Nakayama", "Haruna  Nakashima", 3, "possible_false_positive"),
    ("Sō  Nakagawa", "Rilo  Nakagawa", 4, "possible_false_positive"),
    ("Gilli  Johansen", "Gilli  Johansef", 4, "near_token_edit_distance_le_1"),
    ("Hannah  Schmidt", "Hannah  Schmidt", 0, "exact_normalised_name"),
]


def test_published_distances_and_reasons(spark):
    from linkwell.functions import distance

    rows = spark.createDataFrame([(i, 0, 1, *p) for i, p in enumerate(PUBLISHED)], "i int, a_idx bigint, b_idx bigint, a_name string, b_name string, d bigint, want string")
    bits = lambda c: encode.encode_token_or(F.col(c), kind="murmur")
    got = evaluate.classified(rows).select("d", "want", "reason", distance.hamming(bits("a_name"), bits("b_name")).alias("got")).collect()
    assert all(r.d == r.got and r.want == r.reason for r in got)


def test_fixed_width_forms(spark, tmp_path, linkage):
    from linkwell.functions import records

    long = "é" * 100
    rows = spark.createDataFrame([(7, "ab"), (1 << 20, long), (0, "")], "idx bigint, name string")
    value = records.serialized(F.col("idx"), F.col("name"))
    got = [(bytes(r[0]), r[1]) for r in rows.select(value, records.deserialized(value)).collect()]
    assert got[0][0] == (7).to_bytes(4, "little") + (2).to_bytes(4, "little") + b"ab" + bytes(126)
    assert [len(v) for v, _ in got] == [136] * 3
    assert [tuple(b) for _, b in got] == [(7, "ab"), (1 << 20, "é" * 64), (0, "")]
    four = rows.select(records.serialized_bucket(F.array_repeat(records.serialized_hex(F.col("idx"), F.col("name")), 4)))
    with pytest.raises(Exception, match="exceeds the cap"):
        four.collect()
    with pytest.raises(Exception, match="unexpected length"):
        rows.select(records.deserialized_bucket(value)).collect()
    with pytest.raises(Exception, match="invalid name length"):
        rows.select(records.deserialized(F.unhex(F.lpad(F.lit("FF000000"), 272, "0")))).select(F.expr("*")).union(rows.select(records.deserialized(F.unhex(F.rpad(F.lit("00000000FF000000"), 272, "0"))))).collect()
    sinks.write_settings(spark, str(tmp_path / "conf"), 5)
    assert sinks.settings(spark, str(tmp_path / "conf")) == {"PAYLOAD_BITS": "2048", "CHUNK_BITS": "64", "PAYLOAD_CHUNKS": "32", "HAMMING_D": "4", "CANDIDATE_OFFSET": "0", "MAX_CANDIDATES": "5"}
    sinks.write_summary(linkage.summary, str(tmp_path / "summary"))
    assert any(r.value.startswith("strict_f1: 0.") for r in spark.read.text(str(tmp_path / "summary")).collect())
    verify.require_known(linkage.candidates, linkage.encoded)
    with pytest.raises(ValueError, match="party 1"):
        verify.require_known(spark.createDataFrame([(0, -5)], "a_idx bigint, b_idx bigint"), linkage.encoded)


def test_opened_matches_in_files(spark, tmp_path, linkage):
    odd = [(0, 1, 'say "hi", \\ x', 2, "", 0, 3), (5, 7, "plain", 7, "O'C, \\\\ ,\\\"", 0, -1)]
    rows = spark.createDataFrame(odd, "round bigint, a_idx bigint, a_name string, b_idx bigint, b_name string, proj_dist bigint, payload_dist bigint")
    for df in (rows.repartition(2), linkage.matches, rows.limit(0)):
        path = str(tmp_path / "opened")
        sinks.write_opened(df, path)
        assert sorted(map(tuple, sinks.read_opened(spark, path).collect())) == sorted(tuple(r) for r in df.select(*sinks.OURS).collect())
    sinks.write_opened(rows.limit(1).coalesce(1), path)
    (part,) = [p for p in (tmp_path / "opened").iterdir() if p.suffix == ".csv"]
    assert part.read_text().split("\n")[:2] == ["round,party0_index,party0_name,party1_index,party1_name,proj_dist,payload_dist", '0,1,"say \\"hi\\", \\\\ x",2,"",0,3']
    (tmp_path / "plain.csv").write_text('round,party0_index,party0_name,party1_index,party1_name,proj_dist,payload_dist\n1,2,A B,3,"C ""D"", E",0,-1\n')
    assert tuple(sinks.read_opened(spark, str(tmp_path / "plain.csv")).first()) == (1, 2, "A B", 3, 'C "D", E', 0, -1)
    (tmp_path / "bad.csv").write_text("1,2,A B,3\n")
    with pytest.raises(Exception, match="not a line"):
        sinks.read_opened(spark, str(tmp_path / "bad.csv")).collect()


def test_inputs_are_checked(spark, tmp_path):
    assert sinks.matched_ids(spark, str(tmp_path / "none")).collect() == []
    lines = DEFAULT.bits // DEFAULT.chunk_bits + 1
    for name, n in (("p0", 2 * lines), ("p1", 2 * lines), ("short", 5)):
        (tmp_path / name).write_text("1\n" * n)
    path = lambda *names: [str(tmp_path / n) for n in names]
    sinks.require_inputs(spark, path("p0", "p1"), 2)
    with pytest.raises(ValueError, match="mismatch"):
        sinks.require_inputs(spark, path("p0", "short"), 2)
    with pytest.raises(FileNotFoundError, match="none"):
        sinks.require_inputs(spark, path("p0", "none"), 2)


def test_positions_of_files(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_text("x,full_name\n" + "".join(f"{i},{'' if i % 9 == 0 else f'name {i}'}\n" + "\n" * (i % 50 == 0) for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = sorted(map(tuple, names.read_names(spark, str(path), "full_name").collect()))
        few = names.read_names(spark, str(path), "full_name", 2000)
        assert few.count() == 2000 and few.agg(F.max("idx")).first()[0] == 1999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, "" if i % 9 == 0 else f"name {i}") for i in range(5000)]


def test_missed_rows_of_files(spark):
    clean = spark.createDataFrame([(0, "A B", "N1"), (1, "C D", "N2"), (2, "", "N3"), (4, "E F", "N5")], "idx bigint, name string, record_id string")
    fuzzy = spark.createDataFrame([(i, n, n, "none", False) for i, n in ((0, "A B"), (1, "C X"), (2, "Y"), (4, "E G"), (5, "Z"))], "idx bigint, fuzzy_name string, original_name string, error_type string, is_noisy boolean")
    found = spark.createDataFrame([(0, 0), (4, 1)], "a_idx bigint, b_idx bigint")
    assert evaluate.default_n(found).first()[0] == 5 and evaluate.default_n(found.limit(0)).first()[0] == 0
    got = evaluate.missed_of_files(clean, fuzzy, found)
    assert [(r.idx, r.record_id, r.clean_name, r.fuzzy_name, r.original_name) for r in got.collect()] == [(1, "N2", "C D", "C X", "C X"), (4, "N5", "E F", "E G", "E G")]
    n = spark.createDataFrame([(4,)], "n_records bigint")
    assert [r.idx for r in evaluate.missed_of_files(clean, fuzzy, found, n).collect()] == [1]


def exchanged(plan):
    """Rows that the exchanges of an executed plan wrote."""
    kind = plan.nodeName()
    if kind == "AdaptiveSparkPlan":
        return exchanged(plan.executedPlan())
    if kind.endswith("QueryStage"):
        return exchanged(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "Exchange" else 0
    return own + sum(exchanged(plan.children().apply(i)) for i in range(plan.children().size()))


def test_exact_pairs_of_one_frequent_part(spark):
    draw = random.Random(5)
    others = [b for b in range(2048) if b % 5]
    vectors = [sorted([5, 10, 15, *draw.sample(others, 10)]) for _ in range(300)]
    near = [sorted(set(v) ^ set(draw.sample(others, i % 7))) for i, v in enumerate(vectors)] + vectors[:20] + [[], [5]]
    rows = [(p, i, str(i), v) for p, side in enumerate((vectors + [[], [1, 2]], near)) for i, v in enumerate(side)]
    enc = spark.createDataFrame(rows, "party bigint, idx bigint, name string, bits array<bigint>")
    pairs = verify.exact_pairs(enc)
    got = sorted(map(tuple, pairs.collect()))
    sides = [[(i, set(v)) for q, i, _, v in rows if q == p] for p in (0, 1)]
    assert got == sorted((i, j, len(a ^ b)) for i, a in sides[0] for j, b in sides[1] if len(a ^ b) <= 4)
    assert exchanged(pairs._jdf.queryExecution().executedPlan()) < 30 * len(rows)


def test_exact_pairs_read_their_table_once(spark, small):
    pairs = registry.QUERIES["hamming_exact_join"](spark, small)
    pairs.collect()
    assert pairs._jdf.queryExecution().executedPlan().executedPlan().toString().count("Scan parquet") == 1


def test_exact_pairs_of_short_vectors(spark):
    import itertools
    import random

    rng = random.Random(6)
    rows = [(p, i, f"n{i}", sorted(rng.sample(range(40), rng.randrange(0, 9)))) for p in (0, 1) for i in range(150)]
    enc = spark.createDataFrame(rows, "party bigint, idx bigint, name string, bits array<bigint>")
    got = {(r.a_idx, r.b_idx, r.payload_dist) for r in verify.exact_pairs(enc).collect()}
    sides = [[(i, set(b)) for p, i, _, b in rows if p == side] for side in (0, 1)]
    assert got == {(i, j, len(a ^ b)) for (i, a), (j, b) in itertools.product(*sides) if len(a ^ b) <= 4}


def test_unverified_shares_fail(spark, linkage, monkeypatch):
    from linkwell.operators import shares

    few = linkage.matches.limit(3)
    assert {r.verified_share_count for r in verify.share_dump(few, party=1).collect()} == {2048}
    monkeypatch.setattr(shares, "verified", lambda value, *_: value == 0)
    with pytest.raises(Exception, match="not verified"):
        verify.share_dump(few).collect()


def test_times_of_rounds(linkage):
    rows = linkage.timed(rounds=2).collect()
    counts = {r.round: r.n_matches for r in verify.round_matches(linkage.meetings, linkage.matches).collect()}
    assert [(r.round, r.n_matches) for r in rows] == [(0, counts[0]), (1, counts[1])] and all(r.seconds > 0 for r in rows)


def test_linkage_of_files(spark, tmp_path, linkage):
    rows = linkage.fuzzy.orderBy("idx").collect()
    quote = lambda x: '"' + x.replace('"', '""') + '"'
    (tmp_path / "clean.csv").write_text("record_id,full_name_romanised\n" + "".join(f"N{i},{quote(r.name)}\n" for i, r in enumerate(rows)))
    (tmp_path / "fuzzy.csv").write_text("fuzzy_name,error_type,is_noisy\n" + "".join(f"{quote(r.fuzzy_name)},{r.error_type},{r.is_noisy}\n" for r in rows))
    paths = str(tmp_path / "clean.csv"), str(tmp_path / "fuzzy.csv")
    files = Linkage.of_files(spark, *paths)
    at = {i: r.idx for i, r in enumerate(rows)}
    assert files.n == len(rows) and files.masks == linkage.masks
    assert [(at[r.idx], r.name, r.fuzzy_name, r.error_type, r.is_noisy) for r in files.fuzzy.orderBy("idx").collect()] == [tuple(r) for r in rows]
    few = Linkage.of_files(spark, *paths, LinkageConfig(row_limit=50))
    assert few.n == 50 and few.matches.agg(F.max("a_idx")).first()[0] < 50
    (tmp_path / "short.csv").write_text("fuzzy_name\nA\n")
    with pytest.raises(ValueError, match="as many rows"):
        Linkage.of_files(spark, paths[0], str(tmp_path / "short.csv"))
