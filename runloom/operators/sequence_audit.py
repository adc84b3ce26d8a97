"""Sequence lengths, suspicious sequences and how they were cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..session import park
from .frequency import reason_counts
from .profiles import sequence_quality
from .tables import beside, codes_where

LONG = "suspiciously_long_sequence"


def sequence_table(df: DataFrame) -> DataFrame:
    """One row per sequence id: length, modes, distinct classes and states, shares.

    Ties of a mode go to the smallest text. Partial aggregates meet per id, so a
    crowded sequence is no single task; the class and state sets stay tiny.
    """
    cls = F.coalesce("observed_zap_class", F.lit("unknown"))
    states = F.size(F.collect_set("hidden_state")) if "hidden_state" in df.columns else F.lit(0)
    return df.groupBy(coerce.sequence_or_default(F.col("sequence_id")).alias("sequence_id")).agg(
        F.count(F.lit(1)).alias("sequence_length"),
        F.mode("sequence_resolution_type", True).alias("resolution_type"),
        F.mode("sequence_quality_flag", True).alias("quality_flag"),
        F.mode("sequence_quality_reason", True).alias("quality_reason_mode"),
        F.size(F.collect_set(cls)).alias("observed_unique_classes"),
        states.alias("hidden_unique_states"),
        coerce.share(cls == "no_score").alias("no_score_share"),
        coerce.share(cls == "unknown").alias("unknown_share"),
    )


def length_distribution(table: DataFrame) -> DataFrame:
    counts = table.groupBy("sequence_length").agg(F.count(F.lit(1)).alias("sequence_count"))
    return counts.withColumn("share_of_sequences", F.col("sequence_count") / table.agg(F.count(F.lit(1))).scalar())


def length_stats(table: DataFrame) -> DataFrame:
    """One row; quantiles are exact and computed from the counts per length."""
    length, count = F.col("sequence_length"), F.col("sequence_count")
    return length_distribution(table).agg(
        F.sum(count).alias("n_sequences"), F.min(length).alias("min"), F.max(length).alias("max"),
        F.percentile(length, F.lit(0.5), count).alias("median"),
        (F.sum(length * count) / F.sum(count)).alias("mean"),
        F.percentile(length, F.lit(0.95), count).alias("p95"),
    )


def long_threshold(stats: DataFrame) -> Column:
    return stats.select(F.greatest(F.lit(25), F.ceil("p95"))).scalar()


def suspicious(table: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Sequences that are long, flat, almost without score, or badly cut."""
    flat = F.col("observed_unique_classes") <= 1
    marked = table.withColumn("long_threshold", long_threshold(stats or length_stats(table)))
    reasons = codes_where(
        flat_observed_and_hidden=flat & (F.col("hidden_unique_states") <= 1),
        low_quality_segmentation=F.col("quality_flag") == "low",
        mostly_no_score_flat_sequence=(F.col("no_score_share") >= 0.95) & flat,
        suspiciously_long_sequence=F.col("sequence_length") >= F.col("long_threshold"),
    )
    return marked.withColumn("suspicion_reasons", reasons).where(F.size("suspicion_reasons") > 0)


def multi_bout(found: DataFrame) -> DataFrame:
    """Suspicious sequences that may hold several bouts."""
    loose = F.col("quality_reason_mode").isin("surrogate_no_context", "surrogate_partial_context")
    enough = F.col("sequence_length") >= F.greatest(F.lit(10), F.floor(F.col("long_threshold") / 2))
    return found.where(F.array_contains("suspicion_reasons", LONG) | (loose & enough))


def by_length(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("sequence_length"), "sequence_id")


def audit(df: DataFrame, context_sources: dict[str, str | None] | None = None, explicit_source: str | None = None,
          preview_ids: int = 30) -> dict[str, DataFrame]:
    """Tables of the audit. The summary shows the first `preview_ids` possible multi-bout ids; their table has all."""
    table = park(sequence_table(df), "sequences")  # one row per sequence, read by every part below
    stats = length_stats(table)
    found = suspicious(table, stats)
    shares = sequence_quality(df)
    sources = context_sources or {}
    unnamed = [f for f in ("weight_class", "opponent_name", "tournament_name", "event_date") if not sources.get(f)]
    counted = found.agg(
        F.count(F.lit(1)).alias("suspicious_sequences"),
        F.count(F.when(F.array_contains("suspicion_reasons", LONG), 1)).alias("suspicious_long_sequences"),
        F.count(F.when(F.array_contains("suspicion_reasons", "flat_observed_and_hidden"), 1)).alias("suspicious_flat_sequences"),
    )
    preview = by_length(multi_bout(found)).limit(preview_ids).agg(F.collect_list("sequence_id").alias("potential_multi_bout_ids"))
    rows = df.agg(F.count(F.lit(1)).alias("rows_total"))
    limit = stats.select(F.greatest(F.lit(25), F.ceil("p95")).alias("long_sequence_threshold"))
    summary = beside(stats, rows, shares, limit, counted, preview).withColumns({
        "explicit_sequence_available": F.col("explicit_sequence_share") > 0,
        "explicit_sequence_source_column": F.lit(explicit_source).cast("string"),
        "surrogate_based_segmentation": (F.col("explicit_sequence_share") <= 0) & (F.col("surrogate_sequence_share") > 0),
        "context_missing_fields": F.array(*[F.lit(f) for f in unnamed]).cast("array<string>"),
        "warnings": codes_where(
            no_explicit_ids=F.col("explicit_sequence_share") <= 0, mostly_surrogate=F.col("surrogate_sequence_share") >= 0.80,
            much_low_quality=F.col("low_quality_share") >= 0.30, suspicious_sequences_found=F.col("suspicious_sequences") > 0,
            context_fields_missing=F.lit(bool(unnamed)),
        ),
    })
    return {
        "summary": summary,
        "length_distribution": length_distribution(table),
        "suspicious_sequences": by_length(found),
        "potential_multi_bout_sequences": by_length(multi_bout(found)),
        "surrogate_reasons": reason_counts(df.where(F.col("sequence_resolution_type") == "surrogate"), "sequence_quality_reason"),
        "fallback_reasons": reason_counts(df.where(F.col("sequence_resolution_type") == "fallback"), "sequence_quality_reason"),
    }
