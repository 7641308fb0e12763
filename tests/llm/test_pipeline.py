"""The corpus pipeline, stage by stage."""

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F

from linkwell.llm import jaccard, language, mixing, runtime
from linkwell.llm.runtime import documents, written
from tests.llm.test_scans import brute_overlaps
from tests.llm.test_similar import brute


def test_stages(spark, small):
    docs = documents(spark, small)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "sharding"]
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], small), f"test-{name}"))
        if name != "sharding":
            assert steps[-1].columns == docs.columns
    raw, known, unique, clean, mixed, sharded = (s.collect() for s in steps)
    scores = {r.doc_id: r for r in language.identify(docs).collect()}
    assert {r.doc_id for r in known} == {d for d, r in scores.items() if r.lang_pred != "und" and r.score >= 0.4}
    groups = brute([(r.doc_id, r.text) for r in known], 5, 80)
    assert sorted(r.doc_id for r in unique) == sorted({c for _, c in groups.values()})
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{small}/benchmark.parquet'").fetchall())
    leaks = {d for d, _ in brute_overlaps({r.doc_id: r.text for r in unique}, items)}
    assert leaks and {r.doc_id for r in clean} == {r.doc_id for r in unique} - leaks
    totals = {r.doc_id: r for r in mixing.mix(steps[3])[1].collect()}
    times = {d: round(r.taken / r.size) for d, r in totals.items() if r.size}
    for d, n in times.items():
        assert sum(r.doc_id == d for r in mixed) == n
    assert sorted(r.doc_id for r in sharded) == sorted(r.doc_id for r in mixed) and all(r.shard for r in sharded)
    assert len(raw) >= len(known) >= len(unique) >= len(clean)
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small)
    assert rows.count() > 0 and rows.columns[-1] == "shard"


def test_run_on_awkward_tables(spark, awkward, tmp_path):
    """Nulls, empty and long texts, repeated rows, names that the stages use; and no rows at all."""
    docs = awkward.withColumns({"lw_shard": F.lit("a"), "m_id": F.lit(1), "target": F.lit(2.0), "lw_bad": F.lit(None).cast("long")})
    bench = spark.createDataFrame([(1, "of no text that is here, in other words"), (None, None), (2, "")], "item_id bigint, text string")
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some"))
    assert got.columns == [*docs.columns, "shard_"]
    kept = got.collect()
    assert kept and {r.doc_id for r in kept} <= {4, 5, 7, None} and all(r.shard == "z" and r.lw_shard == "a" and r.m_id == 1 and r.shard_ for r in kept)
    assert sum(r.doc_id == 4 for r in kept) <= 2
    got.write.parquet(str(tmp_path / "out"))
    nothing = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert nothing.columns == got.columns and nothing.count() == 0


def test_stages_give_memory_back(spark, monkeypatch):
    """Within a stage every table that is written gives the driver's freed memory back, steps of seconds apart."""
    assert runtime.trim(spark)
    seen = []
    monkeypatch.setattr(runtime, "trim", seen.append)
    monkeypatch.setattr(runtime, "_released", float("-inf"))
    rows = spark.range(3)
    runtime.discard(written(rows, "test-alone"))
    assert not seen
    with runtime.scratch(spark):
        assert written(rows, "test-first").count() == 3
        assert len(seen) == 1
        written(rows, "test-at-once")
        assert len(seen) == 1
        monkeypatch.setattr(runtime, "_released", float("-inf"))
        written(rows, "test-later")
        assert len(seen) == 2
