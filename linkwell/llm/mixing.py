"""Mixing sources to target weights by a low-discrepancy source schedule.

1. Sizes per source give targets: the weights share ``share`` of all words, a target
   stops at ``max_epochs`` times its source's size, the excess is reshared by weight.
2. One slot for every ``block`` words of the targets: points of the golden-ratio sequence
   frac((k + 1) * phi) fall into the cumulative target shares; point k names the source of
   slot k, and a slot's rank among the slots of its source names the block that it takes. A
   source with a target that no point meets has one slot, after the others.
3. The words of a source, its documents in a hashed order, make a stream of ``max_epochs``
   epochs. Its target's worth of the stream is cut into as many blocks of equal word count as
   it has slots: ``block`` words each but for the points' discrepancy. Slots join blocks on
   (source, rank). Every source so takes its target, whatever its size.

Sources of any skew: the hashed order of a source is a running sum over hashed buckets,
whose totals are summed first, so no task sees a whole source. Slots grow in number with the
words, blocks do not grow.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a
source of its own, ordered last; a source of size 0 has target 0; a very long text is cut into
the blocks that it meets; an empty table gives an empty result; rows equal in doc_id and text
are taken in the order in which they are read, so which of them takes more is not fixed, what they take together
is; ties between hashes go by doc_id. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwell.llm.runtime import discard, written

GOLDEN = 0.6180339887498949
BLOCK = 1024
BUCKET_DIGITS = 4  # of the hashed order, in hexadecimal: 65,536 buckets a source
RUN = 1 << 16  # slots that are ranked together
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; null: 0."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size) -> plus source_no, weight, target. One row per source.

    Water filling in one sort: a source is capped when the level at which it fills,
    max_epochs * size / weight, lies below the common level; sources are capped in
    order of that ratio.
    """
    by_name = Window.partitionBy("one").orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    by_ratio = Window.partitionBy("one").orderBy("fills_at", "source_no")
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("one")
    no = F.row_number().over(by_name) - 1
    ws = F.array(*[F.lit(float(w)) for w in weights])
    at = (
        sizes.withColumn("one", F.lit(1))
        .withColumn("source_no", no)
        .withColumn("weight", F.element_at(ws, (F.col("source_no") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(max_epochs))
        .withColumn("fills_at", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("left_words", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(after))
        # the level if this source and those after it are all below their caps
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
        .withColumn("open", (F.col("level") < F.col("fills_at")))
        .withColumn("final_level", F.min(F.when(F.col("open"), F.struct("fills_at", "source_no", "level"))).over(everything)["level"])
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("final_level"), F.lit(float("inf"))) * F.col("weight"))
    return at.select("source", "source_size", "source_no", "weight", target.cast("double").alias("target"))


def schedule(spark, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source_no, rank): the source of every slot and its rank among that source's slots."""
    whole = targets.agg(F.coalesce(F.round(F.sum("target")), F.lit(0.0)).cast("long").alias("words"), F.count("*").alias("sources")).first()
    slots = -(-whole.words // block)
    run = Window.partitionBy("one").orderBy("source_no")
    ends = (
        targets.withColumn("one", F.lit(1))  # a row a source
        .withColumn("end", F.sum("target").over(run) / F.nullif(F.sum("target").over(Window.partitionBy("one")), F.lit(0.0)))
        .withColumn("low", F.coalesce(F.lag("end").over(run), F.lit(0.0)))
        .where(F.col("target") > 0)
    )
    # one grid cell, or a few, hold the points of a source: an equi-join finds them
    cells = max(1024, 4 * whole.sources)
    ends = ends.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("end") * cells), F.lit(cells).cast("long"))))
    ).select("source_no", "low", "end", "cell")
    points = spark.range(slots).select(F.col("id").alias("slot"), (((F.col("id") + 1) * F.lit(GOLDEN)) % 1.0).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * cells))
    inside = (F.col("point") >= F.col("low")) & (F.col("point") < F.col("end"))
    named = points.join(ends, "cell").where(inside).select("slot", "source_no")
    # ranks in two steps: within runs of slots, after the counts of the earlier runs
    named = named.withColumn("run", F.floor(F.col("slot") / RUN))
    counts = written(named.groupBy("source_no", "run").agg(F.count("*").alias("n")), "mix-runs")
    start = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("source_no", "run", F.coalesce(F.sum("n").over(start), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_no", "run").orderBy("slot")
    ranked = named.join(before, ["source_no", "run"]).select(
        "slot", "source_no", (F.col("before") + F.row_number().over(inside) - 1).alias("rank")
    )
    missed = targets.where("target > 0").join(counts, "source_no", "left_anti")
    return ranked.unionByName(missed.select((F.lit(slots) + F.col("source_no")).alias("slot"), "source_no", F.lit(0).cast("long").alias("rank")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The pieces of the mix and the documents' totals.

    pieces: (slot, row_id, doc_id, epoch, piece_start, piece_words): in slot order, words
    [piece_start, piece_start + piece_words) of a document.
    totals: (row_id, row_key, doc_id, size, source_size, target, taken), one row per row of ``docs``;
    row_key is a hash of all its columns.
    """
    spark = docs.sparkSession
    order = F.concat_ws(" ", F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),  # fixed once written
        F.xxhash64(*docs.columns).alias("row_key"),
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.md5(order).alias("at"),
    )
    rows = rows.withColumn("bucket", F.substring("at", 1, BUCKET_DIGITS))
    rows = written(rows, "mix-sizes")
    per_bucket = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    sizes = per_bucket.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = written(source_targets(sizes, weights, share, max_epochs), "mix-targets")
    slots = written(schedule(spark, targets, block), "mix-slots")
    # of a source's stream the first ``words``, in blocks of ``least`` words, the first ``longer`` of them one longer
    many = slots.groupBy("source_no").agg(F.count("*").alias("slots"))
    cut = targets.join(many, "source_no", "left").withColumn("words", F.round("target").cast("long"))
    cut = cut.withColumn("least", F.expr("words div coalesce(slots, 1)")).withColumn("longer", F.expr("words % coalesce(slots, 1)"))
    cut = written(cut.drop("weight", "slots"), "mix-blocks")  # a row a source

    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_bucket.select(
        F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")
    )
    bases = bases.join(cut, bases.b_source.eqNullSafe(cut.source)).drop("source")
    inside = Window.partitionBy("source", "bucket").orderBy("at", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(bases, placed.source.eqNullSafe(bases.b_source) & (placed.bucket == bases.b_bucket)).select(
        "row_id", "row_key", "doc_id", "size", "source_size", "source_no", "target", "words", "least", "longer", (F.col("base") + F.col("before")).alias("start")
    )
    placed = written(placed, "mix-placed")
    discard(rows, per_bucket, targets, cut)

    epochs = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch")
    spans = placed.where("size > 0").select("*", epochs)
    spans = spans.withColumn("start", F.col("start") + F.col("epoch") * F.col("source_size"))
    spans = spans.where("start < words").withColumn("stop", F.least(F.col("start") + F.col("size"), F.col("words")))
    rank = lambda at: f"if({at} < longer * (least + 1), {at} div (least + 1), longer + ({at} - longer * (least + 1)) div least)"
    blocks = F.expr(f"explode(sequence({rank('start')}, {rank('(stop - 1)')}))").alias("rank")
    pieces = spans.select("row_id", "doc_id", "epoch", "source_no", "start", "stop", "least", "longer", blocks)
    edge = lambda r: r * F.col("least") + F.least(r, F.col("longer"))
    first = F.greatest(F.col("start"), edge(F.col("rank")))
    last = F.least(F.col("stop"), edge(F.col("rank") + 1))
    pieces = pieces.select(
        "row_id", "doc_id", "epoch", "source_no", "rank", (first - F.col("start")).alias("piece_start"), (last - first).alias("piece_words")
    )
    pieces = pieces.join(slots.hint("merge"), ["source_no", "rank"])
    pieces = pieces.select("slot", "row_id", "doc_id", "epoch", "piece_start", "piece_words")
    taken = pieces.groupBy("row_id").agg(F.sum("piece_words").alias("taken"))
    totals = placed.join(taken, "row_id", "left").select(
        "row_id", "row_key", "doc_id", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken")
    )
    return pieces, totals


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it whole: taken / size, rounded.

    Only the document at the end of a source's stream is taken in part. Rows equal in all columns
    come as often as the mix takes them together.
    """
    _, totals = mix(docs, **options)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    times = totals.groupBy("doc_id", "row_key").agg(F.sum(times).alias("m_times"), F.count("*").alias("m_same"))
    times = written(times.where("m_times > 0"), "mix-times").withColumnsRenamed({"doc_id": "m_id", "row_key": "m_key"})
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("m_row"), docs.doc_id.alias("m_doc"), F.xxhash64(*names).alias("m_hash"))
    same = F.col("m_doc").eqNullSafe(F.col("m_id")) & (F.col("m_hash") == F.col("m_key"))
    taken = keyed.join(times.hint("shuffle_hash"), same)
    if not times.where("m_same > 1").isEmpty():
        taken = taken.where("m_same = 1").unionByName(taken.where("m_same > 1").dropDuplicates(["m_doc", "m_hash"]))
    return taken.select("m_row", F.explode(F.array_repeat(F.lit(0), F.col("m_times").cast("int"))).alias("m_copy")).select("m_row.*")
