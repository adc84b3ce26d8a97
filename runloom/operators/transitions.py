"""Moves from one state to the next inside runs of one sequence id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce
from .ordered import Ordering, with_next


def adjacent_pairs(df: DataFrame, order: Ordering, state: str = "hidden_state", sequence: str = "sequence_id") -> DataFrame:
    """(from_state, to_state) for each pair of neighbouring rows of one sequence."""
    narrow = df.select(
        *order.keys, order.row, F.col(state).alias("from_state"),
        coerce.sequence_or_default(F.col(sequence)).alias("_id"),
    )
    stepped = with_next(narrow, order, ["from_state", "_id"])
    return stepped.where(F.col("next__id") == F.col("_id")).select("from_state", F.col("next_from_state").alias("to_state"))


def count_transitions(df: DataFrame, order: Ordering, state: str = "hidden_state", sequence: str = "sequence_id") -> DataFrame:
    """Counts per (from, to), with share of all moves and a self-loop flag.

    States × states rows at most, so the share window sees a tiny table.
    """
    counts = adjacent_pairs(df, order, state, sequence).groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(1)))).withColumn(
        "is_self_loop", F.col("from_state") == F.col("to_state")
    )


def name_states(df: DataFrame, names: dict[int, str], state: Column, alias: str) -> DataFrame:
    """State number to name; a number without a name reads state_<n>."""
    return df.withColumn(alias, state_name(names, state))


def state_name(names: dict[int, str], state: Column) -> Column:
    fallback = F.concat(F.lit("state_"), state.cast("string"))
    if not names:
        return fallback
    pairs = [F.lit(x) for k, v in names.items() for x in (int(k), v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), state.cast("int")), fallback)


def named_transitions(counts: DataFrame, names: dict[int, str]) -> DataFrame:
    return counts.withColumn("from_name", state_name(names, F.col("from_state"))).withColumn(
        "to_name", state_name(names, F.col("to_state"))
    )


def direction_shares(counts: DataFrame) -> DataFrame:
    """Forward, backward and self share; all self when there is no move at all."""
    total = F.sum("count")

    def part(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("count")).otherwise(0)) / total, F.lit(0.0))

    step = F.col("to_state") - F.col("from_state")
    return counts.agg(
        part(step > 0).alias("forward_share"),
        part(step < 0).alias("backward_share"),
        F.coalesce(F.sum(F.when(step == 0, F.col("count")).otherwise(0)) / total, F.lit(1.0)).alias("self_share"),
    )


def transition_differences(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows that only one of the two count tables has."""
    cols = ["from_state", "to_state", "count"]
    a, b = stored.select(*cols), recomputed.select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("stored_only")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("recomputed_only"))
    )


def unexpected_names(df: DataFrame, column: str, canonical: list[str]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(canonical)).select(F.col(column).alias("name")).distinct()


def top_transitions(counts: DataFrame, k: int = 12) -> DataFrame:
    """The k most frequent moves as `a -> b` labels. `counts` carries the names."""
    label = F.concat_ws(" -> ", F.col("from_name"), F.col("to_name"))
    return (
        counts.groupBy(label.alias("transition")).agg(F.sum("count").alias("count"))
        .orderBy(F.desc("count"), "transition").limit(k)
    )
