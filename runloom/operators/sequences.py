"""Sequence ids from context and episode numbers, and runs of equal ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from .ordered import Ordering, number_breaks, over_key

BASE_KEY = "_base_key"


def with_base_key(df: DataFrame, explicit: str | None = None) -> DataFrame:
    """Context key of each row; rows with an explicit id get a key of their own kind."""
    context = F.concat(
        F.col("sheet_name"), F.lit("::"), F.col("athlete_id"), F.lit("::w="), F.col("weight_class"),
        F.lit("::opp="), F.col("opponent_name"), F.lit("::tour="), F.col("tournament_name"),
        F.lit("::date="), F.col("event_date"),
    )
    given = coerce.safe_text(F.col(explicit)) if explicit else F.lit("")
    return df.withColumn("_given", given).withColumn(
        BASE_KEY,
        F.when(F.col("_given") != "", F.concat(F.col("sheet_name"), F.lit("::explicit::"), F.col("_given")))
        .otherwise(context),
    )


def assign_sequences(
    df: DataFrame, explicit: str | None = None, row: str = "source_row_index", block: int | None = None
) -> DataFrame:
    """Append the sequence id, how it was found, its quality and the reason.

    Without an explicit id, rows of one context are cut into blocks: a new one
    starts where the episode number does not rise. A missing number compares as
    no rise on either side.
    """
    keyed = with_base_key(df, explicit).withColumn("_surrogate", F.col("_given") == "")
    keyed = keyed.withColumn("_episode", coerce.episode_number(F.col("episode_id")))
    order = Ordering((BASE_KEY, "_surrogate"), row, **({"block": block} if block else {})).inspect(keyed)

    cut = number_breaks(keyed, order, ["_episode"], lambda before, now: now["_episode"] <= before["_episode"], "_block_no")
    cut = over_key(cut, order, _numbered=F.max(F.col("_episode").isNotNull()))
    filled = sum(((F.col(c) != "").cast("int") for c in ("weight_class", "opponent_name", "tournament_name", "event_date")),
                 F.lit(0))
    numbered = F.col("_numbered")
    explicit_row = ~F.col("_surrogate")
    lost = F.col(BASE_KEY).isNull()
    out = cut.withColumn("_context", filled)
    context = F.col("_context")
    out = out.withColumns({
        "sequence_id": F.when(explicit_row, F.col(BASE_KEY))
        .when(lost, F.concat_ws("::", F.col("sheet_name"), F.lit("fallback"), F.col("athlete_id"), F.col(row)))
        .otherwise(F.format_string("%s::block_%02d", F.col(BASE_KEY), F.col("_block_no"))),
        "sequence_resolution_type": F.when(explicit_row, "explicit").when(lost, "fallback").otherwise("surrogate"),
        "sequence_quality_flag": F.when(explicit_row, "high").when(lost, "low")
        .when((context >= 2) & numbered, "high").when((context >= 1) | numbered, "medium").otherwise("low"),
        "sequence_quality_reason": F.when(explicit_row, "explicit_sequence_id")
        .when(lost, "fallback_source_row_index")
        .when((context >= 2) & numbered, "surrogate_context_and_episode_id")
        .when((context == 0) & numbered, "surrogate_episode_only")
        .when(context >= 1, "surrogate_partial_context")
        .otherwise("surrogate_no_context"),
    })
    return out.drop(BASE_KEY, "_given", "_surrogate", "_episode", "_block_no", "_at", "_opens", "_closes", "_numbered",
                    "_context")


def number_runs(df: DataFrame, order: Ordering, sequence: str = "sequence_id", number: str = "run_no") -> DataFrame:
    """Runs of neighbouring rows with the same id; the same id later is a new run.

    Adds the run number, `_at`, `_opens` and `_closes` (see `number_breaks`).
    """
    normal = df.withColumn("_id", coerce.sequence_or_default(F.col(sequence)))
    return number_breaks(normal, order, ["_id"], lambda before, now: now["_id"] != before["_id"], number).drop("_id")


def run_lengths(df: DataFrame, order: Ordering, sequence: str = "sequence_id") -> DataFrame:
    """One row per run: its id and how many rows it has, pre-aggregated before the shuffle."""
    runs = number_runs(df, order, sequence)
    return runs.groupBy(*order.keys, "run_no").agg(
        F.first(coerce.sequence_or_default(F.col(sequence))).alias("sequence_id"),
        F.count(F.lit(1)).alias("run_length"),
    )
