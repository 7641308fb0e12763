"""Evaluation of opened matches against positions as truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwell.config import DEFAULT, LinkageConfig
from linkwell.functions.distance import near_token_match, subset_relation
from linkwell.functions.normalize import evaluation_tokens, is_blank, normalize_for_evaluation, sorted_unique

#: The verdicts.
INDEX_MATCH, EXACT, ORDER = "index_match", "exact_normalised_name", "token_order_equivalent"
DUPLICATE, MISSING, FALSE_POSITIVE = "duplicate_token_equivalent", "missing_or_extra_token", "possible_false_positive"


def near_reason(config: LinkageConfig = DEFAULT) -> str:
    return f"near_token_edit_distance_le_{config.max_token_edit}"


def equivalence(a: Column, b: Column, config: LinkageConfig = DEFAULT) -> Column:
    """The first rule that makes two normalised token lists equivalent, or FALSE_POSITIVE."""
    joined = lambda t: F.array_join(t, " ")
    return (
        F.when(joined(a) == joined(b), EXACT)
        .when(F.array_sort(a) == F.array_sort(b), ORDER)
        .when(sorted_unique(a) == sorted_unique(b), DUPLICATE)
        .when(subset_relation(a, b, config.min_shared_tokens), MISSING)
        .when(near_token_match(a, b, config), near_reason(config))
        .otherwise(FALSE_POSITIVE)
    )


def enriched(matches: DataFrame) -> DataFrame:
    """Matches with normalised names and token keys of both sides."""
    rows = matches
    for x in "ab":
        tokens = evaluation_tokens(F.col(f"{x}_name"))
        rows = rows.withColumn(f"{x}_tokens", tokens)
        rows = rows.withColumns(
            {
                f"{x}_norm": normalize_for_evaluation(F.col(f"{x}_name")),
                f"{x}_sorted_key": F.array_join(F.array_sort(f"{x}_tokens"), " "),
                f"{x}_unique_key": F.array_join(sorted_unique(F.col(f"{x}_tokens")), " "),
            }
        )
    return rows


def classified(matches: DataFrame, config: LinkageConfig = DEFAULT) -> DataFrame:
    """Enriched matches with their reason: equal positions, an equivalence rule, or a possible false positive."""
    rows = enriched(matches)
    rule = equivalence(F.col("a_tokens"), F.col("b_tokens"), config)
    rows = rows.withColumn("reason", F.when(F.col("a_idx") == F.col("b_idx"), INDEX_MATCH).otherwise(rule))
    return rows.drop("a_tokens", "b_tokens")


def true_positives(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason") == INDEX_MATCH)


def equivalent_duplicates(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("reason").isin(INDEX_MATCH, FALSE_POSITIVE))


def false_positives(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason") == FALSE_POSITIVE)


def expected(fuzzy: DataFrame) -> DataFrame:
    """Rows whose clean and fuzzy names are both there."""
    return fuzzy.where(~is_blank(F.col("name")) & ~is_blank(F.col("fuzzy_name")))


def default_n(matches: DataFrame) -> DataFrame:
    """(n_records), one row: the largest index of either side and one more; 0 without matches."""
    return matches.agg(F.coalesce(F.max(F.greatest("a_idx", "b_idx")) + 1, F.lit(0)).alias("n_records"))


def positional(clean: DataFrame, fuzzy: DataFrame, n: DataFrame) -> DataFrame:
    """Both sides' rows by position, from 0 to n - 1; a missing row is blank.

    clean: (idx, name, record_id); fuzzy: (idx, fuzzy_name, original_name, error_type, is_noisy).
    """
    rows = n.where("n_records > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_records") - 1)).alias("idx"))
    blank = lambda df, skip: [F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes if c != skip]
    both = rows.join(clean, "idx", "left").join(fuzzy, "idx", "left")
    return both.select("idx", *blank(clean, "idx"), *blank(fuzzy, "idx"))


def missed_of_files(clean: DataFrame, fuzzy: DataFrame, matches: DataFrame, n: DataFrame | None = None) -> DataFrame:
    """Expected records that were not opened with themselves, in the order of positions, of ``n``
    (n_records) or by default as many records as the matches name."""
    rows = positional(clean, fuzzy, default_n(matches) if n is None else n)
    found = missed(rows, matches)
    more = rows.select("idx", "record_id", "original_name")
    return found.join(more, "idx").select("idx", "record_id", "clean_name", "fuzzy_name", "original_name", *found.columns[3:]).orderBy("idx")


def missed(fuzzy: DataFrame, matches: DataFrame) -> DataFrame:
    """Expected records that were not opened with themselves, with their names' keys."""
    opened = matches.where(F.col("a_idx") == F.col("b_idx")).select(F.col("a_idx").alias("idx")).distinct()
    rows = expected(fuzzy).join(opened, "idx", "left_anti")
    key = lambda c: F.array_join(F.array_sort(evaluation_tokens(F.col(c))), " ")
    return rows.select(
        "idx",
        F.col("name").alias("clean_name"),
        "fuzzy_name",
        "error_type",
        "is_noisy",
        normalize_for_evaluation(F.col("name")).alias("clean_norm"),
        normalize_for_evaluation(F.col("fuzzy_name")).alias("fuzzy_norm"),
        key("name").alias("clean_sorted_key"),
        key("fuzzy_name").alias("fuzzy_sorted_key"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _harmonic(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def summary(rows: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """One row: counts and quality. Ratios are 0 where their denominator is, so no match at all has a summary too."""
    count = lambda what: F.count_if(what).alias
    reason = F.col("reason")
    found = rows.agg(
        F.count("*").alias("opened"),
        count(reason == INDEX_MATCH)("tp"),
        count(~reason.isin(INDEX_MATCH, FALSE_POSITIVE))("dup"),
        count(reason == FALSE_POSITIVE)("fp"),
        F.countDistinct(F.when(reason == INDEX_MATCH, F.col("a_idx"))).alias("hit"),
    )
    both = expected(fuzzy).agg(F.count("*").alias("valid")).join(fuzzy.agg(F.count("*").alias("evaluated")), F.lit(True)).join(found, F.lit(True))  # one row each
    tp, dup, fp, opened, valid = (F.col(c) for c in ("tp", "dup", "fp", "opened", "valid"))
    both = both.withColumn("missed", valid - F.col("hit"))
    both = both.withColumns({"precision": _ratio(tp, opened), "recall": _ratio(tp, valid), "adjusted": _ratio(tp + dup, opened)})
    six = lambda c: F.round(c, 6)
    return both.select(
        F.col("evaluated").alias("evaluated_records"),
        F.col("opened").alias("opened_candidate_pairs"),
        tp.alias("true_positives"),
        dup.alias("equivalent_duplicates"),
        fp.alias("possible_false_positives"),
        F.col("missed").alias("missed_true_matches"),
        valid.alias("valid_expected_records"),
        six(F.col("precision")).alias("strict_precision"),
        six(F.col("recall")).alias("strict_recall"),
        six(_harmonic(F.col("precision"), F.col("recall"))).alias("strict_f1"),
        six(F.col("adjusted")).alias("adjusted_precision"),
        six(_harmonic(F.col("adjusted"), F.col("recall"))).alias("adjusted_f1"),
        six(_ratio(fp + dup, opened)).alias("strict_false_discovery_rate"),
        six(_ratio(fp, opened)).alias("possible_false_discovery_rate"),
        six(_ratio(F.col("missed"), valid)).alias("false_negative_rate"),
    )
