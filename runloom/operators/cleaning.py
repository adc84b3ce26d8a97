"""Cleaning of episode rows: fill, trim, and drop rows that carry nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce, lexicon as lx
from ..functions.names import columns_with, find_column
from .ordered import Ordering, fill_down


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def strip_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: coerce.strip(F.col(f"`{c}`")) for c in text_columns(df)})


def null_columns(df: DataFrame, keep: list[str] = ()) -> list[str]:
    """Columns without a single value. One aggregate job."""
    names = [c for c in df.columns if c not in keep]
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if counts[f"n{i}"] == 0]


def drop_null_columns(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    return df.drop(*null_columns(df, keep))


def _null_if_blank(name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.when(~coerce.strip(c).isin(lx.BLANK_EXACT), c)


def fill_names(df: DataFrame, row: str, across_sheets: bool = False, block: int | None = None) -> DataFrame:
    """Carry the athlete down over blank cells, within each sheet by default.

    With `across_sheets` the carry runs over the whole table in row order, so a
    blank first row takes the athlete of the sheet before.
    """
    athlete, sheet = find_column(df.columns, lx.CLEAN_ATHLETE), find_column(df.columns, lx.CLEAN_SHEET)
    names = [n for n in dict.fromkeys((sheet, athlete)) if n]
    out = df.withColumns({n: _null_if_blank(n) for n in names})
    size = {"block": block} if block else {}
    if sheet and (across_sheets or not athlete):
        return fill_down(out, Ordering((), row, **size), names)
    if sheet:
        out = out.withColumn(sheet, F.coalesce(F.col(f"`{sheet}`"), F.lit("")))
        return fill_down(out, Ordering((sheet,), row, **size).inspect(out), [athlete])
    return fill_down(out, Ordering((), row, **size), names) if names else out


def is_empty_row(df: DataFrame, ignore: list[str]) -> Column:
    blanks = []
    for f in df.schema:
        if f.name in ignore:
            continue
        c = F.col(f"`{f.name}`")
        blanks.append(c.isNull() | (coerce.strip(c) == "") if isinstance(f.dataType, T.StringType) else c.isNull())
    return reduce(lambda a, b: a & b, blanks, F.lit(True))


def is_aggregate_row(athlete: str | None) -> Column:
    return F.coalesce(coerce.has_total_word(F.col(f"`{athlete}`")), F.lit(False)) if athlete else F.lit(False)


def activity(df: DataFrame) -> Column:
    """Sum of absolute values over the tactical columns."""
    names = columns_with(df.columns, lx.ACTIVITY_WORDS)
    return reduce(lambda a, b: a + b, [F.abs(coerce.number_or_zero(df, n)) for n in names], F.lit(0.0))


def has_episode(episode: str | None) -> Column:
    if episode is None:
        return F.lit(False)
    c = F.col(f"`{episode}`").cast("string")
    header = F.coalesce(F.lower(c).rlike(lx.HEADER_LIKE_EPISODE), F.lit(False))
    return coerce.is_episode_id(c) & ~header


def has_result(df: DataFrame, result: str | None) -> Column:
    return coerce.number_or_zero(df, result) != 0.0


def mark_rows(df: DataFrame, row: str) -> DataFrame:
    """Append `drop_reason`: empty, aggregate, low_information, or null to keep."""
    names = [c for c in df.columns if c != row]
    athlete, sheet = find_column(names, lx.CLEAN_ATHLETE), find_column(names, lx.CLEAN_SHEET)
    episode, result = find_column(names, lx.CLEAN_EPISODE), find_column(names, lx.CLEAN_RESULT)
    dull = ~has_episode(episode) & ~has_result(df, result) & (activity(df) <= 0)
    reason = (
        F.when(is_empty_row(df, [row, *([sheet] if sheet else [])]), F.lit("empty"))
        .when(is_aggregate_row(athlete), F.lit("aggregate"))
        .when(dull, F.lit("low_information"))
    )
    return df.withColumn("drop_reason", reason)


def clean(df: DataFrame, row: str = "source_row_index", across_sheets: bool = False, block: int | None = None) -> DataFrame:
    """Trim, fill the names down, and keep only rows that carry an episode."""
    filled = fill_names(strip_text(df), row, across_sheets, block)
    return mark_rows(filled, row).where(F.col("drop_reason").isNull()).drop("drop_reason")


def cleaning_report(df: DataFrame, row: str = "source_row_index") -> DataFrame:
    """Rows per drop reason; kept rows read `kept`."""
    marked = mark_rows(strip_text(df), row)
    return marked.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))
