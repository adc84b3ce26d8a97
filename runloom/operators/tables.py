"""Small table helpers shared by the audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Put one-row tables next to each other as scalar subqueries."""
    for i, other in enumerate(others):
        held = f"_t{i}"
        first = first.withColumn(held, other.select(F.struct(*other.columns)).scalar())
        first = first.select(*[c for c in first.columns if c != held], *[F.col(f"{held}.{c}").alias(c) for c in other.columns])
    return first


def unpivot(df: DataFrame, columns: dict[str, Column], *keep: str, name: str = "field", value: str = "value") -> DataFrame:
    """One row per (row, column). Expressions must share one type."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias(name), c.alias(value)) for n, c in columns.items()]))
    return df.select(*keep, pairs.alias("_p")).select(*keep, "_p.*")


def top_per_key(df: DataFrame, keys: list[str], k: int, *order: Column | str, rank: str = "rank") -> DataFrame:
    """First k rows of each key. Spark cuts to k rows per key and partition before
    the shuffle, so a crowded key stays small."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def codes_where(**conditions: Column) -> Column:
    """Array of the names whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def names_where(name: str, condition: Column) -> Column:
    """Sorted names of a short table's rows that meet the condition."""
    return F.array_sort(F.collect_list(F.when(condition, F.col(name))))
