"""How far the observed classes can be trusted, column by column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..functions.names import find_column
from ..session import park
from . import frequency
from .observation import ObservationRules, finish_columns, finish_like_columns
from .tables import beside, codes_where, names_where, top_per_key


def _any_positive(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [coerce.is_positive(F.col(f"`{c}`")) for c in columns], F.lit(False))


def finish_signals(df: DataFrame, rules: ObservationRules, names: list[str] | None = None) -> DataFrame:
    """One row per finish-like column: how filled, how positive, and is it mapped."""
    names = names or df.columns
    mapped = finish_columns(names, rules)
    candidates = sorted({*finish_like_columns(names), *mapped})
    counts = frequency.value_counts(df, candidates)
    tops = frequency.top_values(counts).groupBy("column_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "rows"))),  # twelve at most
                    lambda v: F.struct(v["value"].alias("value"), v["rows"].alias("rows"))).alias("value_frequencies")
    )
    classes = F.lit(None).cast("array<string>")
    for name, found in mapped.items():
        classes = F.when(F.col("column_name") == name, F.array(*[F.lit(c) for c in found])).otherwise(classes)
    return (
        frequency.signal_shares(df, candidates)
        .join(frequency.distinct_values(counts), "column_name", "left")
        .join(tops, "column_name", "left")
        .withColumn("mapped_classes", F.coalesce(classes, F.array().cast("array<string>")))
        .withColumn("covered_by_mapping", F.size("mapped_classes") > 0)
        .withColumn("mapping_status", F.when(F.col("covered_by_mapping"), "mapped").otherwise("unsupported"))
        .withColumn("distinct_non_empty_values", F.coalesce("distinct_values", F.lit(0)))
        .drop("distinct_values")
    )


def unsupported_values(df: DataFrame, signals: DataFrame, k: int = 20) -> DataFrame:
    """Top values of columns that carry positive signals no rule covers."""
    open_ = signals.where((F.col("positive_rows") > 0) & ~F.col("covered_by_mapping"))
    columns = [r["column_name"] for r in open_.select("column_name").collect()]  # column names only
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column_name string, raw_value string, rows bigint, share_within_column double, share_of_total_rows double, "
                "non_empty_rows_in_column bigint, positive_rows_in_column bigint"
        )
    counts = frequency.value_counts(df, columns).where(~F.lower("value").isin("nan", "none", "<na>"))
    total = df.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    return (
        top_per_key(counts, ["column_name"], k, F.desc("rows"), "value").drop("rank")
        .join(open_.select("column_name", F.col("non_empty_rows").alias("non_empty_rows_in_column"),
                           F.col("positive_rows").alias("positive_rows_in_column")), "column_name")
        .withColumnRenamed("value", "raw_value")
        .withColumn("share_within_column", F.col("rows") / F.greatest("non_empty_rows_in_column", F.lit(1)))
        .withColumn("share_of_total_rows", F.col("rows") / total)
    )


def score_values(df: DataFrame, rules: ObservationRules, score_column: str) -> DataFrame:
    """Rows and share per rounded score, and whether a class exists for it.

    Unlike the mapping itself, a decimal comma is not read here.
    """
    rounded = F.bround(coerce.number_of(df, score_column)).try_cast("int")
    counts = df.select(rounded.alias("score_rounded")).where(F.col("score_rounded").isNotNull()).groupBy("score_rounded").agg(
        F.count(F.lit(1)).alias("rows")
    )
    return counts.withColumn("share", F.col("rows") / counts.agg(F.sum("rows")).scalar()).withColumn(
        "supported", F.col("score_rounded").isin(0, *rules.score_classes)
    )


def resolution_shares(df: DataFrame) -> DataFrame:
    counts = df.groupBy("observation_resolution_type").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows") / df.agg(F.count(F.lit(1))).scalar())


def audit(df: DataFrame, rules: ObservationRules | None = None, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of the audit. `df` holds the source columns and the observation columns."""
    rules = rules or ObservationRules()
    names = names or df.columns
    mapped = finish_columns(names, rules)
    score_column = find_column(names, rules.score_columns)
    signals = park(finish_signals(df, rules, names), "signals")  # a row per column, read by every part below
    tables = {
        "finish_signals": signals,
        "unsupported_values": unsupported_values(df, signals),
        "crosstab": frequency.mapping_crosstab(df),
        "match_counts": frequency.finish_match_counts(df),
        "resolution_shares": resolution_shares(df),
    }
    loose = [r["column_name"] for r in signals.where((F.col("positive_rows") > 0) & ~F.col("covered_by_mapping")).collect()]
    presence = {
        f"{cls}_positive_rows": F.count(F.when(_any_positive([n for n, found in mapped.items() if cls in found]), 1))
        for cls in ("hold", "arm_submission", "leg_submission")
    }
    summary = df.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count(F.when(_any_positive(list(mapped)), 1)).alias("mapped_finish_positive_rows"),
        F.count(F.when(_any_positive(loose), 1)).alias("unmapped_finish_positive_rows"),
        *[c.alias(n) for n, c in presence.items()],
    ).withColumns({
        "mapping_version": F.lit(rules.version),
        "score_column_used": F.lit(score_column),
        "candidate_finish_columns": F.lit(len({*finish_like_columns(names), *mapped})),
        "supported_finish_columns": F.array(*[F.lit(c) for c in sorted(mapped)]).cast("array<string>"),
        "unsupported_finish_columns": F.array(*[F.lit(c) for c in sorted(loose)]).cast("array<string>"),
    })
    if score_column:
        tables["scores"] = score_values(df, rules, score_column)
        missing = tables["scores"].where(~F.col("supported")).agg(names_where("score_rounded", F.lit(True)).alias("unsupported_scores"))
        summary = beside(summary, missing)
    else:
        summary = summary.withColumn("unsupported_scores", F.array().cast("array<int>"))
    direct, gaps = F.col("mapped_finish_positive_rows"), F.col("unmapped_finish_positive_rows")
    known = F.size("supported_finish_columns") > 0
    tables["summary"] = summary.withColumns({
        "direct_finish_positive_share": direct / F.greatest("rows_total", F.lit(1)),
        "direct_finish_available": known & (direct > 0),
        "mapping_gap_detected": gaps > 0,
        "warnings": codes_where(
            no_finish_columns=~known, finish_columns_all_negative=known & (direct == 0),
            unmapped_positive_columns=F.size("unsupported_finish_columns") > 0,
            mapping_gap=known & (gaps > 0), unsupported_finish_values=gaps > 0,
            unsupported_scores=F.size("unsupported_scores") > 0,
        ),
    })
    return tables


