"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-cased runs of letters and digits. Each fixed mask picks some token
positions of a span and ignores the others; the hashes of what it picks are joined between
benchmark items and documents, so a replaced token in an ignored position does no harm.
Every hit names a diagonal (document position less item position); along it the tokens are
compared, and the segment of the highest score (MATCH a token that agrees, MISMATCH one
that does not) must reach what the item's length asks: LEAST_SCORE, of short items LEAST_SHARE
of their tokens, and SPAN matches at least. Exact passages, parts of them and passages with
replaced tokens are found alike. Items of fewer tokens than a mask spans are found where all of them
stand in a row; items of fewer than LEAST_TOKENS tokens say nothing and match nothing.

Main path: DataFrame functions only. A constant bit array drops most seeds that no item has before
they become rows; it only saves work. Seeds of the benchmark are broadcast up to
BROADCAST_SEEDS rows, counted first; beyond, hits come from a shuffled join of the seeds
alone and texts are joined to hits.

Defined results: null and empty texts match nothing; rows and items are told apart by their
place, so repeated rows, equal items and null ids are each reported; of segments of one score the
earliest counts; very long texts are searched whole; empty tables give an empty result; extra
columns are ignored, whatever their names, and kept by ``without_benchmark``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwell.llm.runtime import written

MASKS = ("1110110", "1101011")
SPAN = max(map(len, MASKS))
MATCH, MISMATCH, LEAST_SCORE = 1, -2, 10
LEAST_SHARE, LEAST_TOKENS = 0.6, 4
BROADCAST_SEEDS = 1_000_000
FILTER_BITS = 17


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a leading separator leaves an empty first token."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")


def seeds(hashes: Column, masks: list[str]) -> Column:
    """[(at, seed)]: the hashes of all masks at all positions, mask after mask, from an array of token hashes.

    Positions past the end count as null: such seeds hit by chance only, and fail the comparison.
    """

    def of(mask: str) -> Column:
        picks = [i for i, c in enumerate(mask) if c == "1"]
        seed = lambda x, at: F.xxhash64(F.lit(int(mask, 2)), x, *[F.get(hashes, at + i) for i in picks[1:]])
        return F.transform(hashes, lambda x, at: F.struct(at.alias("at"), seed(x, at).alias("seed")))

    return F.concat(*[of(mask) for mask in masks])


def _place(seed: Column) -> Column:
    return seed.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def _filter_of(item_seeds: DataFrame) -> Column:
    """A bit array of fixed size, as a constant array of 32 bits each, with the places of all seeds."""
    words = [0] * (1 << FILTER_BITS - 5)
    for r in item_seeds.select(_place(F.col("seed")).cast("int").alias("p")).distinct().toLocalIterator():  # 2^FILTER_BITS at most
        words[r.p >> 5] |= 1 << (r.p & 31)
    return F.expr("array(" + ",".join(f"{w}L" for w in words) + ")")


def _seeded(df: DataFrame, keep: list[str], masks: list[str], array: Column | None = None) -> DataFrame:
    """``keep``, words and, exploded, (seed, at); of a filter ``array`` only seeds that it may hold."""
    hashed = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    every = seeds(F.col("hashes"), masks)
    if array is not None:
        held = lambda p: F.getbit(F.element_at(array, (F.shiftright(p, 5) + 1).cast("int")), p.bitwiseAND(31).cast("int")) == 1
        every = F.filter(every, lambda x: held(_place(x["seed"])))
    return hashed.select(*keep, "words", F.inline(every))


def least_score(n: Column, score: int = LEAST_SCORE) -> Column:
    """What a segment of an item of ``n`` tokens must reach: of LEAST_SCORE, and LEAST_SHARE of them, the less."""
    return F.least(F.lit(score), F.greatest(F.least(n, F.lit(SPAN)), F.ceil(n * LEAST_SHARE))).cast("int")


def _best_segment(same: Column) -> Column:
    """(score, start, stop) of the best segment of an array of booleans; the earliest of equals."""
    start = F.struct(
        F.lit(0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("stop"),
        F.lit(0).alias("run"), F.lit(0).alias("run_start"), F.lit(0).alias("at"),
    )

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["run"] > 0, a["run"]).otherwise(0) + F.when(x, MATCH).otherwise(MISMATCH)
        run_start = F.when(a["run"] > 0, a["run_start"]).otherwise(a["at"])
        better = run > a["score"]
        return F.struct(
            F.when(better, run).otherwise(a["score"]).alias("score"),
            F.when(better, run_start).otherwise(a["start"]).alias("start"),
            F.when(better, a["at"] + 1).otherwise(a["stop"]).alias("stop"),
            run.alias("run"),
            run_start.alias("run_start"),
            (a["at"] + 1).alias("at"),
        )

    return F.aggregate(same, start, step)


def overlaps(docs: DataFrame, benchmark: DataFrame, score: int = LEAST_SCORE) -> DataFrame:
    """(row_id, doc_id, text_key, item_no, item_id, doc_token, item_token, n_tokens, n_matched, score): for each
    row and item that overlap, the best segment. ``row_id`` and ``item_no`` tell equal ids apart;
    text_key is the hash of the row's text."""
    words = F.filter(tokens(F.col("text")), lambda w: w != "")
    items = benchmark.select(F.monotonically_increasing_id().alias("item_no"), "item_id", words.alias("words"))
    items = written(items.where(F.size("words") >= LEAST_TOKENS), "benchmark-items")  # numbers that stay
    short = [r.n for r in items.where(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct().collect()]  # fewer than SPAN
    item_seeds = _seeded(items.where(F.size("words") >= SPAN), ["item_no"], list(MASKS)).where(F.col("at") + SPAN <= F.size("words"))
    for n in sorted(short):
        item_seeds = item_seeds.unionByName(_seeded(items.where(F.size("words") == n), ["item_no"], ["1" * n]).where("at = 0"))
    item_seeds = written(item_seeds.select("seed", "item_no", F.col("at").alias("item_at"), F.size("words").alias("item_n")), "benchmark-seeds")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.xxhash64("text").alias("text_key"), tokens(F.col("text")).alias("words"))
    masks, array = [*MASKS, *("1" * n for n in sorted(short))], _filter_of(item_seeds)
    found = _seeded(rows, ["row_id", "doc_id", "text_key"], masks, array)
    diagonal = (F.col("at") - F.col("item_at")).alias("diagonal")
    # the document's tokens along the diagonal: from that of the item's first token, or the text's first
    low, high = F.greatest(F.col("diagonal"), F.lit(0)), F.col("diagonal") + F.col("item_n")
    along = F.slice("words", low + 1, high - low).alias("along")
    if item_seeds.count() <= BROADCAST_SEEDS:
        hits = found.join(F.broadcast(item_seeds), "seed").select("row_id", "doc_id", "text_key", "item_no", diagonal, "item_n", "words")
        hits = hits.select("row_id", "doc_id", "text_key", "item_no", "diagonal", along)
    else:
        rows = written(rows, "benchmark-rows")  # row ids that stay
        found = _seeded(rows.select("row_id", "words"), ["row_id"], masks, array)
        hits = found.select("row_id", "seed", "at").join(item_seeds, "seed").select("row_id", "item_no", diagonal, "item_n").distinct()
        hits = hits.join(rows, "row_id").select("row_id", "doc_id", "text_key", "item_no", "diagonal", along)
    hits = hits.groupBy("row_id", "item_no", "diagonal").agg(*[F.first(c).alias(c) for c in ("doc_id", "text_key", "along")])
    hits = hits.join(items.withColumnRenamed("words", "item"), "item_no")
    skipped = F.greatest(-F.col("diagonal"), F.lit(0))  # item tokens before the text's first
    same = F.transform("along", lambda w, i: F.coalesce(w == F.get("item", i + F.col("skipped")), F.lit(False)))
    hits = hits.withColumn("skipped", skipped.cast("int")).withColumn("same", same)
    hits = hits.withColumn("best", _best_segment(F.col("same"))).where(F.col("best.score") >= least_score(F.size("item"), score))
    first = F.greatest(F.col("diagonal"), F.lit(0)) + F.col("best.start")
    matched = F.size(F.filter(F.slice("same", F.col("best.start") + 1, F.col("best.stop") - F.col("best.start")), lambda x: x))
    hits = hits.select(
        "row_id",
        "doc_id",
        "text_key",
        "item_no",
        "item_id",
        F.struct(
            F.col("best.score").cast("long").alias("score"),
            (-first).cast("long").alias("order"),  # of equal scores the earliest
            first.cast("long").alias("doc_token"),
            (F.col("skipped") + F.col("best.start")).cast("long").alias("item_token"),
            (F.col("best.stop") - F.col("best.start")).cast("long").alias("n_tokens"),
            matched.cast("long").alias("n_matched"),
        ).alias("x"),
    )
    best = hits.groupBy("row_id", "item_no").agg(*[F.first(c).alias(c) for c in ("doc_id", "text_key", "item_id")], F.max("x").alias("x"))
    return best.select("row_id", "doc_id", "text_key", "item_no", "item_id", "x.doc_token", "x.item_token", "x.n_tokens", "x.n_matched", "x.score")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text overlaps with an item; others of their doc_id stay."""
    # written, so that Spark sees its size and shuffles texts only where it is large
    bad = overlaps(docs, benchmark).select(F.col("doc_id").alias("lw_bad"), F.col("text_key").alias("lw_key")).distinct()
    bad = written(bad, "benchmark-leaks")
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.lw_bad) & (F.xxhash64(docs.text) == bad.lw_key), "left_anti")
