"""Deterministic synthetic names and noise: every choice is a hash of the seed and the record's position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwell.config import DEFAULT, LinkageConfig
from linkwell.functions.encode import hash_unit
from linkwell.functions.normalize import is_blank, strip_diacritics
from linkwell.sources.names import record_id_of

#: Kinds of noise, equally likely.
OPERATIONS = (
    "deletion", "insertion", "substitution", "transposition", "vowel_swap", "diacritic_drop",
    "equivalent_forename", "drop_middle", "abbrev_middle", "abbrev_forename", "name_swap",
)
#: Neighbours of each letter on a keyboard, or by look and sound.
NEIGHBOURS = {
    "a": "qwsz", "b": "vghn", "c": "xdfv", "d": "ersfcxt", "e": "rdswi", "f": "rtgdvcs", "g": "tyfhvbj",
    "h": "yugjbn", "i": "uojkl", "j": "uikhmn", "k": "iojlm", "l": "opk", "m": "njk", "n": "bhjm",
    "o": "pikl", "p": "ol", "q": "wa", "r": "tfde", "s": "wedxza", "t": "ygfrd", "u": "yihj",
    "v": "cfgb", "w": "qase", "x": "zsdc", "y": "uhgt", "z": "asx",
}
VOWELS = "aeiou"
FALLBACK, NONE = "substitution_fallback", "none"


def pick(idx: Column, what: str, n: Column | int, config: LinkageConfig = DEFAULT) -> Column:
    """A number below ``n`` that depends on the record and on what is chosen."""
    return (hash_unit(what, config.seed, idx) % n).cast("int")


def _letter(idx: Column, what: str, config: LinkageConfig) -> Column:
    return F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), pick(idx, what, 26, config) + 1, F.lit(1))


def _spliced(s: Column, at: Column, cut: Column | int, put: Column) -> Column:
    """``s`` with ``cut`` characters from position ``at`` replaced by ``put``."""
    cut = F.lit(cut) if isinstance(cut, int) else cut
    return F.concat(F.substring(s, F.lit(1), at - 1), put, F.substring(s, at + cut, F.length(s)))


def mutate(df: DataFrame, config: LinkageConfig = DEFAULT) -> DataFrame:
    """(idx, name) -> plus fuzzy_name, error_type, is_noisy: one kind of noise for a share of the rows.

    A kind that changes nothing falls back to a letter; blank names and names without a
    letter stay as they are.
    """
    i = F.col("idx")
    s = F.trim("name")
    rows = df.withColumn("s", s).withColumn("chars", F.split("s", ""))
    rows = rows.withColumn("letters", F.filter(F.sequence(F.lit(1), F.greatest(F.length("s"), F.lit(1))), lambda p: F.substring(F.col("s"), p, F.lit(1)).rlike("\\p{L}")))
    rows = rows.withColumn("n", F.size("letters"))
    some = F.greatest(F.col("n"), F.lit(1))
    rows = rows.withColumns(
        {
            "op": F.element_at(F.array(*map(F.lit, OPERATIONS)), pick(i, "op", len(OPERATIONS), config) + 1),
            "p": F.coalesce(F.get("letters", pick(i, "place", some, config)), F.lit(1)),
            "q": F.coalesce(F.get("letters", pick(i, "place2", some, config)), F.lit(1)),
            "vowels": F.filter("letters", lambda p: F.lower(F.substring(F.col("s"), p, F.lit(1))).isin(*VOWELS)),
            "words": F.filter(F.split("s", "\\s+"), lambda t: t != ""),
            "plain": strip_diacritics(F.col("s")),
        }
    )
    s, p, length, words, count = F.col("s"), F.col("p"), F.length("s"), F.col("words"), F.size("words")
    one = lambda at: F.substring(F.col("s"), at, F.lit(1))
    cased = lambda new, old: F.when(F.lower(old) != old, F.upper(new)).otherwise(new)
    near = F.create_map(*[F.lit(x) for pair in NEIGHBOURS.items() for x in pair])
    beside = F.element_at(near, F.lower(one(p)))
    beside = F.substring(beside, pick(i, "neighbour", F.length(beside), config) + 1, F.lit(1))
    substitute = F.coalesce(cased(beside, one(p)), _letter(i, "letter", config))
    other = F.when(p < length, p + 1).otherwise(p - 1)
    low, high = F.least(p, other), F.greatest(p, other)
    swapped = _spliced(s, low, 2, F.concat(one(high), one(low)))
    v = F.get("vowels", pick(i, "vowel", F.greatest(F.size("vowels"), F.lit(1)), config))
    others = F.replace(F.lit(VOWELS), F.lower(one(v)), F.lit(""))
    vowel = cased(F.substring(others, pick(i, "vowel2", 4, config) + 1, F.lit(1)), one(v))
    w = lambda k: F.get("words", k)
    first = lambda k: F.concat(F.substring(w(k), 1, 1), F.lit("."))
    results = {
        "deletion": F.when(length > 1, _spliced(s, p, 1, F.lit(""))),
        "insertion": _spliced(s, p, 0, _letter(i, "letter", config)),
        "substitution": _spliced(s, p, 1, substitute),
        "transposition": F.when(length > 1, swapped),
        "vowel_swap": F.when(F.size("vowels") > 0, _spliced(s, v, 1, vowel)),
        "diacritic_drop": F.when(F.col("plain") != s, F.col("plain")),
        "equivalent_forename": F.lit(None).cast("string"),
        "drop_middle": F.when(count == 3, F.concat_ws(" ", w(0), w(2))),
        "abbrev_middle": F.when(count == 3, F.concat_ws(" ", F.concat(w(0), F.lit(".")), first(1), w(2))),
        "abbrev_forename": F.when(count == 3, F.concat_ws(" ", first(0), first(1), w(2))).when(count == 2, F.concat_ws(" ", first(0), w(1))),
        "name_swap": F.when(count == 3, F.concat_ws(" ", w(2), w(0), w(1))).when(count == 2, F.concat_ws(" ", w(1), w(0))),
    }
    result = F.coalesce(*[F.when(F.col("op") == op, x) for op, x in results.items()])
    fallback = _spliced(s, F.col("q"), 1, _letter(i, "letter2", config))
    noisy = (hash_unit("noise", config.seed, i) / 4294967296.0 < config.noise_rate) & ~is_blank(F.col("name")) & (F.col("n") > 0)
    rows = rows.withColumn("noisy", noisy).withColumn("result", result)
    # one struct in an array, opened again: the optimizer leaves what is below as it is, where
    # it would repeat these long expressions in every later filter and lambda
    outcome = F.struct(
        F.when(F.col("noisy"), F.coalesce("result", fallback)).otherwise(F.col("name")).alias("fuzzy_name"),
        F.when(~F.col("noisy"), NONE).when(F.col("result").isNull(), FALLBACK).otherwise(F.col("op")).alias("error_type"),
        F.col("noisy").alias("is_noisy"),
    )
    return rows.select(*df.columns, F.inline(F.array(outcome)))


def error_types(fuzzy: DataFrame) -> DataFrame:
    """Rows of each kind of noise, most first; null is a kind."""
    return fuzzy.groupBy("error_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type")


def sampled_full_names(surnames: DataFrame, forenames: DataFrame, rows: int, config: LinkageConfig = DEFAULT) -> DataFrame:
    """``rows`` draws with replacement from all surname and forename pairs of a country.

    Both tables: (country, name). The pairs are not built: a draw names a country by its
    share of all pairs, and one position in each list.
    """
    from pyspark.sql import Window

    def numbered(df: DataFrame, who: str) -> DataFrame:
        no = F.row_number().over(Window.partitionBy("country").orderBy("name")) - 1
        return df.select("country", F.col("name").alias(who), no.cast("long").alias(f"{who}_no"))

    s, f = numbered(surnames, "surname"), numbered(forenames, "forename")
    sizes = s.groupBy("country").agg(F.count("*").alias("n_s")).join(f.groupBy("country").agg(F.count("*").alias("n_f")), "country")
    run = Window.partitionBy(F.lit(1)).orderBy("country")
    sizes = sizes.withColumn("high", F.sum(F.col("n_s") * F.col("n_f")).over(run)).withColumn("low", F.col("high") - F.col("n_s") * F.col("n_f"))
    total = sizes.agg(F.max("high")).first()[0] or 0
    if not total:
        return s.sparkSession.createDataFrame([], "idx bigint, record_id string, country string, full_name string, is_middle boolean")
    draws = s.sparkSession.range(rows).select(F.col("id").alias("idx"), (hash_unit("draw", config.seed, F.col("id")) % total).alias("at"))
    drawn = draws.join(F.broadcast(sizes), (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))  # one row a country
    drawn = drawn.withColumn("surname_no", F.expr("(at - low) div n_f")).withColumn("forename_no", F.expr("(at - low) % n_f"))
    drawn = drawn.withColumn("middle_no", hash_unit("middle", config.seed, F.col("idx")) % F.col("n_f"))
    drawn = drawn.withColumn("is_middle", hash_unit("has_middle", config.seed, F.col("idx")) / 4294967296.0 < config.middle_name_rate)
    full = drawn.join(s, ["country", "surname_no"]).join(f, ["country", "forename_no"])
    middle = f.select("country", F.col("forename").alias("middle"), F.col("forename_no").alias("middle_no"))
    full = full.join(middle, ["country", "middle_no"])
    second = F.when(F.col("is_middle"), F.col("middle")).otherwise("")
    # concatenation, not joining: without a middle name two spaces stay
    name = F.concat("forename", F.lit(" "), second, F.lit(" "), "surname")
    return full.select("idx", record_id_of(F.col("idx")).alias("record_id"), "country", name.alias("full_name"), "is_middle")
