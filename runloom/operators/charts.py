"""The tables behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profiles import probability_columns
from .tables import unpivot
from .transitions import state_name


def state_points(df: DataFrame, row: str = "source_row_index") -> DataFrame:
    return df.select(row, "hidden_state", "hidden_state_name")


def posterior_points(df: DataFrame, names: dict[int, str] | None = None, row: str = "source_row_index") -> DataFrame:
    """One row per episode and state: the posterior with its label."""
    cols = probability_columns(df)
    long = unpivot(df, {c[8:]: F.col(c) for c in cols}, row, name="state", value="probability")
    state = F.col("state").cast("int")
    return long.select(row, state.alias("state"), state_name(names or {}, state).alias("label"), "probability")


def top_athletes(df: DataFrame, n: int = 10) -> DataFrame:
    counts = df.groupBy("athlete_name").agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.desc("rows"), "athlete_name").limit(n).select("athlete_name")


def keep_top_athletes(df: DataFrame, n: int = 10) -> DataFrame:
    """Rows of the n athletes with most rows. The kept list has n rows."""
    return df.join(top_athletes(df, n), "athlete_name", "left_semi")


def athlete_comparison(df: DataFrame, states: list[int], n: int = 10, result: str = "observed_result") -> DataFrame:
    """Mean result and share of each state per top athlete."""
    shares = [F.avg((F.col("hidden_state") == s).cast("double")).alias(f"share_state_{s}") for s in states]
    return keep_top_athletes(df, n).groupBy("athlete_name").agg(F.avg(result).alias("mean_result"), *shares)


def success_counts(df: DataFrame, result: str = "observed_result", threshold: float = 0.0) -> DataFrame:
    won = F.coalesce(F.col(result), F.lit(0.0)) > threshold
    return df.groupBy("hidden_state_name").agg(
        F.count(F.when(won, 1)).alias("successful"), F.count(F.when(~won, 1)).alias("unsuccessful")
    )


def regime_means(df: DataFrame, features: list[str], state: str = "state") -> DataFrame:
    return df.groupBy(state).agg(*[F.avg(c).alias(c) for c in features])


def transition_cells(numbers: DataFrame) -> DataFrame:
    """A model's move probabilities as rows."""
    return numbers.where(F.col("kind") == "trans").select(
        "model_id", F.col("i").alias("from_state"), F.col("j").alias("to_state"), F.col("value").alias("probability")
    )


def chart_tables(df: DataFrame, transitions: DataFrame, names: dict[int, str]) -> dict[str, DataFrame]:
    states = sorted(names)
    return {
        "state_sequence": state_points(df),
        "state_probabilities": posterior_points(df, names),
        "athletes": athlete_comparison(df, states),
        "success": success_counts(df),
        "transitions": transitions,
    }
