"""Sharding by size-tiered compaction over immutable shards and versioned manifests.

A store is a folder: ``shards/`` holds Parquet files that are never changed, ``manifests/``
tables of the files of a version, and a small file v00000001 and so on for each version,
which names its table. ``append`` writes an arrival as small shards; ``compact`` merges
runs of similar size, a fan-out of them at a time, tier after tier, until they reach the
target size. The tiers are worked out on the shard list first, so rows move once however
many tiers they rise. A version exists once its file does. That file appears whole and
fails to appear if another writer has made that version: a rename without overwriting, or a
hard link on a local file system. Readers only ever see whole versions.

Main path: DataFrame operations; the driver handles version names only. The shard list
is a table; its order is by arithmetic on version, task and file, and ranks in it come in two
steps, so no task holds the list. Texts are shuffled once, in the merge, each run to a task
of its own up to MOST_TASKS: shards are of a size whatever source, key or group of copies
their rows belong to.

Defined results: every row of the arrivals is in exactly one shard of every later
version, nulls, empty and very long texts, repeated rows, ties and extra columns included;
merged shards are of the sum of their runs, one and a half times the target at most by
the sizes of these, and a run of half the target or more is not merged; a single row
larger than that is a shard; an empty arrival makes a version without new shards. The store's
own columns get a _ after their names where rows have columns of those names.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkwell.llm.runtime import discard, drop_path, free_name, new_path, release, written

MANIFEST = "shard string, path string, n_rows long, n_bytes long, tier int, seq long"
FIELDS = [c.split()[0] for c in MANIFEST.split(", ")]
ARRIVAL_ROWS = 4096
FANOUT = 4
TARGET_BYTES = 64 << 20
MOST_TASKS = 10_000
SHARD, ROWS, TIER = "lw_shard", "lw_rows", "lw_tier"
#: seq: version, task and file of an arrival, in bits from above; BUCKET bits of it are ranked together.
TASK_BITS, FILE_BITS, BUCKET = 24, 18, 28


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, arrival_rows: int = ARRIVAL_ROWS):
        if fanout < 2 or target_bytes < 1 or arrival_rows < 1:
            raise ValueError("fanout must be 2 or more, sizes positive")
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.arrival_rows = target_bytes, fanout, arrival_rows
        self.base = max(1, target_bytes // fanout**4)  # bytes of a run of tier 1

    # -- versions

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        fs, folder = self._fs(), self._path("manifests")
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max([int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit()], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], MANIFEST)
        stream = self._fs().open(self._path(f"manifests/v{version:08d}"))
        try:
            name = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{name}")

    def publish(self, name: str, version: int) -> bool:
        """Makes the file of ``version``, with the name of its table; False if it is there. Of any number of
        writers at a time one succeeds."""
        fs, jvm = self._fs(), self.spark.sparkContext._jvm
        tmp, final = self._path(f"manifests/_{uuid.uuid4().hex}"), self._path(f"manifests/v{version:08d}")
        out = fs.create(tmp, False)
        out.write(bytearray(name.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # where a rename replaces files
                at = lambda p: jvm.java.nio.file.Path.of(fs.makeQualified(p).toUri())
                jvm.java.nio.file.Files.createLink(at(final), at(tmp))
            else:
                option = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = option
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(tmp, final, options)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        finally:
            fs.delete(tmp, False)
        return True

    def commit(self, manifest: DataFrame, based_on: int) -> int:
        """Makes version based_on + 1, or raises if another writer made it first."""
        new, name = based_on + 1, f"m{based_on + 1:08d}-{uuid.uuid4().hex}"
        manifest.select(*FIELDS).hint("rebalance").write.parquet(f"{self.root}/manifests/{name}")
        if not self.publish(name, new):
            drop_path(self.spark, f"{self.root}/manifests/{name}")
            raise RuntimeError(f"version {new} was committed by another writer")
        return new

    # -- writing

    def _tier(self, n_bytes: Column) -> Column:
        """The runs of a tier are of sizes within a factor of the fan-out."""
        return F.greatest(F.lit(0), F.floor(F.log(float(self.fanout), F.greatest(n_bytes / self.base, F.lit(1.0))))).cast("int")

    def _listed(self, folder: str, schema) -> DataFrame:
        """One row per file of a folder; only footers and row counts are read."""
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
        file = rows.metadataColumn("_metadata")
        rows = rows.select(file["file_path"].alias("path"), file["file_size"].alias("n_bytes"))
        return rows.groupBy("path", "n_bytes").agg(F.count("*").alias("n_rows")).withColumn("tier", self._tier(F.col("n_bytes")))

    def append(self, docs: DataFrame) -> int:
        """Writes ``docs`` as small shards, without a shuffle, and commits them."""
        based_on = self.version()
        folder = f"{self.root}/shards/a{based_on + 1:08d}-{uuid.uuid4().hex[:8]}"
        docs.write.option("compression", "zstd").option("maxRecordsPerFile", self.arrival_rows).parquet(folder)
        # file names hold the task and the file's number in it: the order of arrival
        part, number = F.regexp_extract("path", "/part-(\\d+)-", 1), F.regexp_extract("path", "-c(\\d+)[.]", 1)
        seq = F.lit(based_on + 1 << TASK_BITS + FILE_BITS) + F.shiftleft(part.cast("long"), FILE_BITS) + number.cast("long")
        new = self._listed(folder, docs.schema).withColumn("seq", seq)
        new = new.withColumn("shard", F.format_string("a%08d-%s-%s", F.lit(based_on + 1), part, number))
        return self.commit(self.manifest(based_on).unionByName(new), based_on)

    def _ranked(self, runs: DataFrame, kind: str) -> DataFrame:
        """``runs`` (run, bytes) with their rank among, and the bytes before them in, the runs of
        their ``kind``, and the bytes of all of these: sums of buckets first."""
        runs = runs.withColumn("bucket", F.shiftright("run", BUCKET))
        buckets = runs.groupBy(kind, "bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
        earlier = Window.partitionBy(kind).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = buckets.select(
            kind, "bucket", F.sum("b").over(Window.partitionBy(kind)).alias("all_bytes"),
            *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in "nb"],
        )
        order = Window.partitionBy(kind, "bucket").orderBy("run")
        before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        runs = runs.withColumn("rank", F.row_number().over(order) - 1).withColumn("before", before).join(buckets, [kind, "bucket"])
        return runs.withColumn("rank", F.col("rank") + F.col("n_before")).withColumn("before", F.col("before") + F.col("b_before"))

    def plan(self, manifest: DataFrame) -> DataFrame:
        """(shard, run, members, run_bytes): the run that each shard ends in.

        In the order of arrival, every full fan-out of a tier becomes one run; runs that a
        fan-out of would pass the target are merged by as many as reach it. Runs of half the
        target or more are done. What stays apart at the end waits for later arrivals.
        """
        runs = written(manifest.select("shard", F.col("n_bytes").alias("bytes"), F.col("seq").alias("run"), F.col("seq").alias("old_run")), "shard-runs")
        for _ in range(3 + math.ceil(math.log(max(2, self.target_bytes / self.base), self.fanout))):
            sizes = runs.groupBy("run").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") * 2 <= self.target_bytes)
            large = F.col("bytes") * self.fanout > self.target_bytes
            sizes = self._ranked(sizes.withColumn("kind", F.when(large, -1).otherwise(self._tier(F.col("bytes")))), "kind")
            group = F.when(F.col("kind") < 0, F.floor(F.col("before") / self.target_bytes)).otherwise(F.floor(F.col("rank") / self.fanout))
            sizes = sizes.withColumn("grp", group)
            full = F.when(F.col("kind") < 0, F.max("all_bytes") >= (F.col("grp") + 1) * self.target_bytes).otherwise(F.count("*") == self.fanout)
            groups = sizes.groupBy("kind", "grp").agg(F.min("run").alias("new_run"), full.alias("full")).where("full").drop("full")
            merged = sizes.select("kind", "grp", F.col("run").alias("old_run")).join(groups, ["kind", "grp"]).select("old_run", "new_run")
            before = runs.select("shard", "bytes", F.col("run").alias("old_run"))
            after = before.join(merged, "old_run", "left").select("shard", "bytes", F.coalesce("new_run", "old_run").alias("run"), "old_run")
            done, runs = runs, written(after, "shard-runs")
            discard(done)
            if runs.where("run <> old_run").isEmpty():
                break
        sizes = runs.groupBy("run").agg(F.sum("bytes").alias("run_bytes"), F.count("*").alias("members"))
        return runs.join(sizes, "run").select("shard", "run", "members", "run_bytes")

    def compact(self, schema) -> int:
        """Merges shards by ``plan`` and commits the outcome as the next version."""
        based_on = self.version()
        old = self.manifest(based_on)
        planned = written(old.join(self.plan(old), "shard"), "shard-plan")
        keep = planned.where("members = 1").select(*FIELDS)
        moving = planned.where("members > 1")
        runs = moving.select("run", F.lit(0).alias("bytes"), F.lit(0).alias("kind")).distinct()
        numbers = written(self._ranked(runs, "kind").select(F.col("run").alias("of_run"), "rank"), "shard-numbers")
        many = numbers.count()
        if not many:
            return self.commit(keep, based_on)
        folder = f"{self.root}/shards/c{based_on + 1:08d}-{uuid.uuid4().hex[:8]}"
        sources = [r.folder for r in moving.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct().toLocalIterator()]
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*sources)
        name = free_name(SHARD, rows.columns)
        tasks = min(many, MOST_TASKS)
        to = moving.join(numbers, F.col("run") == F.col("of_run")).select(
            F.col("path").alias("to_path"), F.format_string("c%08d-%016x", F.lit(based_on + 1), "run").alias("to_shard"), (F.col("rank") % tasks).cast("int").alias("to_task")
        )
        to = written(to, "shard-moves")  # a row a shard; written, so that Spark sees its size before it shuffles texts
        kept = [rows[c] for c in rows.columns]
        rows = rows.join(to, rows.metadataColumn("_metadata")["file_path"] == to.to_path).select(*kept, to.to_shard.alias(name), to.to_task.alias(free_name("lw_task", rows.columns)))
        rows = rows.repartitionById(tasks, F.col(rows.columns[-1])).drop(rows.columns[-1])
        rows.write.option("compression", "zstd").partitionBy(name).parquet(folder)
        release(self.spark)
        shard = F.regexp_extract("path", f"/{name}=([^/]+)/", 1)
        new = self._listed(folder, schema).withColumn("shard", shard).withColumn("seq", F.conv(F.substring("shard", 11, 16), 16, 10).cast("long"))
        version = self.commit(keep.unionByName(new.select(*FIELDS)), based_on)
        discard(planned, numbers, to)
        return version

    # -- reading

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version, then the shard that holds each, its rows and its tier: lw_shard,
        lw_rows and lw_tier, with a _ more where ``schema`` has such names."""
        names = [free_name(x, [f.name for f in schema]) for x in (SHARD, ROWS, TIER)]
        manifest = self.manifest(version)
        paths = [r.path for r in manifest.select(F.regexp_extract("path", "^(.*/shards/[^/]*)", 1).alias("path")).distinct().toLocalIterator()]
        if not paths:
            rows = self.spark.createDataFrame([], schema)
            return rows.withColumns({n: F.lit(None).cast(t) for n, t in zip(names, ("string", "long", "int"), strict=True)})
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)
        files = manifest.select(F.col("path").alias("of_path"), "shard", "n_rows", "tier")
        kept = [rows[c] for c in rows.columns]
        found = rows.join(files, rows.metadataColumn("_metadata")["file_path"] == files.of_path)
        return found.select(*kept, *[files[c].alias(n) for c, n in zip(("shard", "n_rows", "tier"), names, strict=True)])


def shard(docs: DataFrame, root: str | None = None, **options) -> ShardStore:
    """Appends ``docs`` to the store at ``root`` (default: a new one) and compacts it."""
    spark = docs.sparkSession
    store = ShardStore(spark, root or new_path(spark, "store"), **options)
    store.append(docs)
    store.compact(docs.schema)
    return store
