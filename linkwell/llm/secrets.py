"""Secret scans: fixed patterns, and a randomness test battery for what has none.

Patterns give base spans. Other runs of LEAST or more token characters are candidates; an
encoding (hexadecimal, base 32, letters and digits, base 64) is inferred from each one's
characters. Three tests ask whether it could be uniformly random in that alphabet:
chi-squared of the character counts, Wald-Wolfowitz runs about the alphabet's middle, and
lag-one serial correlation. A candidate that passes all three is tested against language,
by the smaller of two p-values, doubled: the chi-squared statistic that text of the same
length would have, from the character frequencies of all candidates that are words; and
the number of changes between letters and digits, of which names and words have two at
most and each more is SWITCH times as likely. Benjamini-Hochberg control at ``FDR`` runs
within strata of length, over the whole corpus: ranks come from counts of p-values in fine
bins, so nothing is sorted or gathered. What is rejected as language is a secret.

Candidates that touch base spans are cut around them; what is left of LEAST or more
characters is tested. Work is in proportion to a text's length, whatever the length of its tokens
and the number of its matches.

Main path: DataFrame functions only. Positions are code points, ends exclusive.

Defined results: a null or empty text has no spans; repeated rows are each scanned; very long texts and
tokens are taken whole; an empty table gives an empty result; added spans never overlap base
spans of the same text; equal p-values are all rejected or none; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwell.llm.runtime import written

#: Fixed patterns: kind, expression, least length of group 2 or of the match.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LEAST = 20
CANDIDATE = f"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
#: Fixed alphabets in the order of their values.
HEX_LOWER, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36_LOWER, BASE36_UPPER = "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
FDR = 0.01
SWITCH = 0.2
PASS_Z = 3.29  # two-sided one in a thousand, for each of the tests
BINS_A_DECADE, DECADES = 100, 16
BLOCK = 256  # matches placed together
WIDE = 1024  # code points; spans that overlap share such a stretch


def _with_places(rows: DataFrame, name: str, pattern: str) -> DataFrame:
    """``rows`` with ``name``: [(start, stop, body)] of all matches of ``pattern`` in ``text``.

    Lengths are summed over blocks of BLOCK matches, then within each block: an array is not
    copied for each of its elements.
    """
    matches, between = F.col("lw_matches"), F.col("lw_between")
    rows = rows.withColumn("lw_matches", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    rows = rows.withColumn("lw_between", F.when(F.size(matches) > 0, F.split("text", pattern, -1)))
    pairs = F.zip_with(matches, F.slice(between, 1, F.size(matches)), lambda m, b: F.struct(F.length(b).alias("gap"), F.length(m).alias("n"), m.alias("body")))
    numbers = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int"))
    rows = rows.withColumn("lw_pairs", F.when(F.size(matches) > 0, pairs))
    # named twice, so that the array is not made anew for each block
    rows = rows.withColumn("lw_blocks", F.when(F.size("lw_pairs") > 0, F.transform(numbers, lambda b: F.slice("lw_pairs", b * BLOCK + 1, F.lit(BLOCK)))))
    bounds = F.array().cast("array<int>")

    def block_starts(a: Column, block: Column) -> Column:
        width = F.aggregate(block, F.lit(0), lambda w, x: w + x["gap"] + x["n"])
        return F.struct((a["at"] + width).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    starts = F.aggregate("lw_blocks", F.struct(F.lit(0).alias("at"), bounds.alias("out")), block_starts)["out"]
    empty = F.array().cast("array<struct<start:int,stop:int,body:string>>")

    def step(a: Column, x: Column) -> Column:
        first = a["at"] + x["gap"]
        one = F.array(F.struct(first.alias("start"), (first + x["n"]).alias("stop"), x["body"].alias("body")))
        return F.struct((first + x["n"]).alias("at"), F.concat(a["out"], one).alias("out"))

    placed = F.flatten(F.zip_with("lw_blocks", starts, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), step)["out"]))
    return rows.withColumn(name, F.coalesce(placed, empty)).drop("lw_matches", "lw_between", "lw_pairs", "lw_blocks")


def _spans(placed: Column, kind: str, order: int) -> Column:
    return F.transform(placed, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), x["stop"].alias("stop"), F.lit(kind).alias("kind")))


def span_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def _normal_below(z: Column) -> Column:
    """The standard normal distribution function (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = tail * F.exp(-z * z / 2) * 0.3989422804014327
    return F.when(z < 0, tail).otherwise(1 - tail)


def _battery(c: DataFrame) -> DataFrame:
    """Candidates (body) with their encoding's size k, length n, chi-squared x and the three z scores."""
    body = F.regexp_replace("body", "=+$", "")
    alphabet = (
        F.when(F.col("core").rlike("^[0-9a-f]+$"), HEX_LOWER)
        .when(F.col("core").rlike("^[0-9A-F]+$"), HEX_UPPER)
        .when(F.col("core").rlike("^[A-Z2-7]+$"), BASE32)
        .when(F.col("core").rlike("^[0-9a-z]+$"), BASE36_LOWER)
        .when(F.col("core").rlike("^[0-9A-Z]+$"), BASE36_UPPER)
        .otherwise(BASE64)
    )
    c = c.withColumn("core", F.translate(body, "-_", "+/")).withColumn("alphabet", alphabet)
    c = c.withColumn("n", F.length("core").cast("double")).withColumn("k", F.length("alphabet").cast("double"))
    c = c.withColumn("chars", F.split("core", "(?!^)"))
    c = c.withColumn("values", F.transform("chars", lambda x: F.instr(F.col("alphabet"), x).cast("double") - (F.col("k") + 1) / 2))
    zero = F.lit(0.0)
    # of each symbol of the alphabet, the square of its count
    times = lambda x: F.length("core") - F.length(F.replace(F.col("core"), x))
    squares = F.aggregate(F.split("alphabet", "(?!^)"), zero, lambda a, x: a + F.pow(times(x), F.lit(2)))
    c = c.withColumn("squares", squares).withColumn("x", F.col("k") / F.col("n") * F.col("squares") - F.col("n"))
    above = F.size(F.filter("values", lambda v: v > 0)).cast("double")
    pairs = F.transform("values", lambda v, i: F.struct(v.alias("v"), F.get("values", i + 1).alias("w")))
    c = c.withColumn("above", above).withColumn("pairs", F.slice(pairs, 1, F.size("values") - 1))
    c = c.withColumn("runs", 1.0 + F.size(F.filter("pairs", lambda p: (p["v"] > 0) != (p["w"] > 0))))
    digits = F.transform("chars", lambda x, i: x.between("0", "9") != F.get("chars", i + 1).between("0", "9"))
    c = c.withColumn("switches", F.size(F.filter(digits, lambda d: d)))
    mean = F.aggregate("values", zero, lambda a, v: a + v) / F.col("n")
    c = c.withColumn("mean", mean)
    power = F.aggregate("values", zero, lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean")))
    product = F.aggregate("pairs", zero, lambda a, p: a + (p["v"] - F.col("mean")) * (p["w"] - F.col("mean")))
    n, k, up, down = F.col("n"), F.col("k"), F.col("above"), F.col("n") - F.col("above")
    expected = 2 * up * down / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    return c.select(
        "row_id", "start", "stop", "body", "n", "k", "x", "squares", "switches",
        ((F.col("x") - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)).alias("z_chi"),
        F.when(variance > 0, (F.col("runs") - expected) / F.sqrt(variance)).otherwise(F.lit(99.0)).alias("z_runs"),
        F.when(power > 0, (product / power + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0)).alias("z_serial"),
        F.col("core").rlike("^[A-Za-z]+$").alias("wordlike"),
    )


def _cut(rows: DataFrame) -> DataFrame:
    """(row_id, start, stop, body): the candidates of ``rows``, cut around base spans, of LEAST or more characters.

    Candidates and base spans meet by the stretches of WIDE code points that they touch.
    """
    stretch = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / WIDE), F.floor((F.col(b) - 1) / WIDE)))
    alone = rows.where("size(base) = 0 AND size(candidates) > 0").select("row_id", F.inline("candidates"))
    both = rows.where("size(base) > 0 AND size(candidates) > 0")
    runs = both.select("row_id", F.inline("candidates"))
    spans = both.select(F.col("row_id").alias("of"), F.inline(F.transform("base", lambda x: F.struct(x["start"].alias("low"), x["stop"].alias("high")))))
    near = runs.select("row_id", "start", "stop", stretch("start", "stop").alias("at")).join(
        spans.select("of", "low", "high", stretch("low", "high").alias("in")), (F.col("row_id") == F.col("of")) & (F.col("at") == F.col("in"))
    )
    near = near.where("low < stop AND start < high").select("row_id", "start", "stop", "low", "high").distinct()
    earlier = Window.partitionBy("row_id", "start").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    after = F.greatest(F.col("start"), F.coalesce(F.max("high").over(earlier), F.col("start")))
    before = near.select("row_id", "start", after.alias("low"), F.col("low").alias("high"))
    last = near.groupBy("row_id", "start", "stop").agg(F.max("high").alias("low")).select("row_id", "start", "low", F.col("stop").alias("high"))
    left = before.unionByName(last).where(F.col("high") - F.col("low") >= LEAST)
    pieces = runs.join(left, ["row_id", "start"]).select(
        "row_id", F.col("low").alias("start"), F.col("high").alias("stop"), F.substring("body", F.col("low") - F.col("start") + 1, F.col("high") - F.col("low")).alias("body")
    )
    whole = runs.join(near.select("row_id", "start").distinct(), ["row_id", "start"], "left_anti").select("row_id", "start", "stop", "body")
    return alone.unionByName(whole).unionByName(pieces)


def scan(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, base, added): spans as arrays of (start, ord, stop, kind), one row per row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", text.alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("candidates", CANDIDATE)):
        rows = _with_places(rows, name, pattern)
    # a match ends with group 2
    values = F.when(F.size("assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)))
    long = F.zip_with("assign", values, lambda x, v: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), (F.length(v) >= 6).alias("long")))
    assign = F.coalesce(F.filter(long, lambda x: x["long"]), F.array().cast("array<struct<start:int,stop:int,long:boolean>>"))
    base = F.concat(_spans(assign, "assign", 0), _spans(F.col("access"), "access", 1), _spans(F.col("hex"), "hex", 2))
    rows = written(rows.select("row_id", "doc_id", base.alias("base"), "candidates"), "secret-rows")

    tested = _battery(_cut(rows))
    # what all words together say about language: the chance that two characters agree, and three
    words = F.when(F.col("wordlike"), F.col("squares") - F.col("n"))
    pairs = F.when(F.col("wordlike"), F.col("n") * (F.col("n") - 1))
    tested = written(tested.withColumn("stratum", F.floor(F.log2(F.col("n") / LEAST) * 2).cast("int")), "secret-tests")
    language = tested.agg((F.coalesce(F.sum(words), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(pairs), F.lit(1.0)), F.lit(1.0))).alias("agree"))
    agree = max(0.03, float(language.first()["agree"]))  # one number of the whole corpus
    n, k = F.col("n"), F.col("k")
    like_words = k + k * (n - 1) * agree - n
    third = agree**1.5 * 1.2
    spread = k / n * F.sqrt(2 * n * n * (agree + agree * agree - 2 * third * agree) + 4 * n * n * n * max(third * agree**0.5 - agree * agree, 1e-4))
    changes = F.pow(F.lit(SWITCH), F.greatest(F.col("switches") - 2, F.lit(0)).cast("double"))
    p = F.least(F.lit(1.0), 2 * F.least(_normal_below((F.col("x") - like_words) / spread), changes))
    passes = (F.abs("z_chi") < PASS_Z) & (F.abs("z_runs") < PASS_Z) & (F.abs("z_serial") < PASS_Z)
    place = F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * BINS_A_DECADE), F.lit(BINS_A_DECADE * DECADES)).cast("int")
    tested = tested.withColumn("bin", F.when(passes, place).otherwise(F.lit(0)))
    bins = tested.groupBy("stratum", "bin").agg(F.count("*").alias("here"))
    below = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    rank, tests = F.sum("here").over(below), F.sum("here").over(Window.partitionBy("stratum"))
    # the largest p of a bin
    bins = bins.withColumn("fits", F.pow(F.lit(10.0), -F.col("bin") / BINS_A_DECADE) <= FDR * rank / tests)
    limits = bins.where("fits").groupBy("stratum").agg(F.min("bin").alias("limit"))
    secrets = tested.join(limits, "stratum").where((F.col("bin") >= F.col("limit")) & (F.col("bin") > 0))
    spans = F.collect_list(F.struct("start", F.lit(3).alias("ord"), "stop", F.lit("random").alias("kind"))).alias("added")
    added = secrets.groupBy("row_id").agg(spans)
    none = F.array().cast("array<struct<start:int,ord:int,stop:int,kind:string>>")
    return rows.join(added, "row_id", "left").select("row_id", "doc_id", "base", F.coalesce("added", none).alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans), one row per row of ``docs``."""
    found = scan(docs)
    count = lambda name, kind: F.size(F.filter(name, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count("base", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        count("added", "random").alias("n_random"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", "added")).alias("spans"),
    )
