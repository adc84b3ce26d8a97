"""One episode out of many: the sample row of a report, and the insight row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from .ordered import Ordering, with_place

SAMPLE_SIGNALS = [
    "maneuver_right_code", "maneuver_left_code", "kfv_code", "vup_code", "outcome_actions_code", "duration", "pause",
    "observed_result",
]
INSIGHT_FEATURES = [
    "maneuver_right_code", "maneuver_left_code", "grips_code", "holds_code", "bodylocks_code", "underhooks_code",
    "posts_code", "kfv_code", "vup_code", "outcome_actions_code", "observed_result",
]


def _activity(df: DataFrame, names: list[str]) -> Column:
    present = [F.abs(coerce.number_or_zero(df, c)) for c in names if c in df.columns]
    return reduce(lambda a, b: a + b, present, F.lit(0.0))


def sample_row(df: DataFrame, row: str = "source_row_index") -> DataFrame:
    """First row with ids and signal, else first with ids, else the first row.

    A top-1 by (rank, row): each task keeps one row.
    """
    ids = coerce.is_text_present(F.col("episode_id")) & coerce.is_text_present(F.col("sequence_id"))
    rank = F.when(ids & (_activity(df, SAMPLE_SIGNALS) > 0), 0).when(ids, 1).otherwise(2)
    warning = F.when(F.col("_rank") == 1, "no_signal").when(F.col("_rank") == 2, "ids_missing")
    return df.withColumn("_rank", rank).orderBy("_rank", row).limit(1).withColumn("warning", warning).drop("_rank")


def is_informative(df: DataFrame) -> Column:
    return (coerce.number_or_zero(df, "observed_result") > 0) | (
        _activity(df, [c for c in INSIGHT_FEATURES if c != "observed_result"]) > 0
    )


def insight_row(df: DataFrame, index: int | None = None, row: str = "source_row_index") -> DataFrame:
    """The first informative episode, or the one at a given index, clamped to the table."""
    marked = df.withColumn("is_informative", is_informative(df))
    if index is None:
        found = marked.orderBy(F.desc("is_informative"), row).limit(1)
        # nothing informative: the order above already gives the first row
        return found.withColumn(
            "selection_reason", F.when(F.col("is_informative"), "auto_first_informative").otherwise("auto_fallback_zero")
        )
    placed = with_place(marked, Ordering((), row), "_place")
    wanted = F.greatest(F.lit(1), F.least(F.lit(index + 1), marked.agg(F.count(F.lit(1))).scalar()))
    return placed.where(F.col("_place") == wanted).drop("_place").withColumn("selection_reason", F.lit("explicit_index"))


def insight(df: DataFrame, index: int | None = None, row: str = "source_row_index") -> DataFrame:
    """State, message code and key features of the chosen episode."""
    found = insight_row(df, index, row)
    message = F.when(F.col("is_informative"), "most_likely_state").otherwise("nearly_empty_episode")
    features = [c for c in INSIGHT_FEATURES if c in df.columns]
    return found.select(
        row, "episode_id", "hidden_state", "hidden_state_name", message.alias("message"), "selection_reason", "is_informative", *features
    )
