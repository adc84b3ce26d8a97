"""How complete the canonical fields are, and what they can support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce, lexicon as lx
from ..session import park
from .episodes import FieldPlan
from .tables import beside, codes_where, names_where, top_per_key, unpivot


def _is_number(df: DataFrame, field: str) -> bool:
    return isinstance(df.schema[field].dataType, T.NumericType)


def field_values(df: DataFrame, fields: list[str], row: str = "source_row_index") -> DataFrame:
    """(field, value, rows, first row): the one table all field measures come from."""
    present = [f for f in fields if f in df.columns]
    cells = {f: F.col(f).cast("string") if _is_number(df, f) else coerce.safe_text(F.col(f)) for f in present}
    return unpivot(df, cells, row).groupBy("field", "value").agg(
        F.count(F.lit(1)).alias("rows"), F.min(row).alias("first_row")
    )


def sample_values(values: DataFrame, k: int = 5) -> DataFrame:
    """First k distinct values per field, in row order."""
    seen = values.where(~F.coalesce("value", F.lit("")).isin("", "NaN"))
    first = top_per_key(seen, ["field"], k, "first_row", "value")
    return first.groupBy("field").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda v: v["value"]).alias("sample_values")  # k at most
    )


def field_quality(df: DataFrame, fields: list[str] | None = None, numeric: list[str] | None = None,
                  row: str = "source_row_index") -> DataFrame:
    """Missing and zero share, distinct values, informative flag, samples per field.

    Informative: at least 10 % filled (text) or non-zero (number), and two values.
    """
    fields = fields or lx.AUDIT_FIELDS
    numeric = lx.AUDIT_NUMERIC_FIELDS if numeric is None else numeric
    values = field_values(df, fields, row)
    is_numeric = F.col("field").isin(numeric) if numeric else F.lit(False)
    value, rows = F.col("value"), F.col("rows")
    num = value.try_cast("double")
    missing = F.when(is_numeric, num.isNull() | F.isnan(num)).otherwise(value == "")
    zero = F.coalesce(num, F.lit(0.0)) == 0.0
    stats = values.groupBy("field").agg(
        F.sum("rows").alias("_all"),
        F.sum(F.when(missing, rows).otherwise(0)).alias("_missing"),
        F.sum(F.when(zero, rows).otherwise(0)).alias("_zero"),
        F.count(F.when(~missing, 1)).alias("unique_values"),
    )
    missing_share = F.col("_missing") / F.col("_all")
    zero_share = F.when(is_numeric, F.col("_zero") / F.col("_all"))
    base = df.sparkSession.createDataFrame([(f, f in df.columns) for f in fields], "field string, available_in_canonical boolean")
    out = base.join(stats, "field", "left").select(
        "field", "available_in_canonical", F.coalesce(missing_share, F.lit(1.0)).alias("missing_share"),
        zero_share.alias("zero_share"), F.coalesce("unique_values", F.lit(0)).alias("unique_values"),
    )
    used = 1.0 - F.coalesce("zero_share", "missing_share")
    out = out.withColumn("informative", F.col("available_in_canonical") & (used >= 0.10) & (F.col("unique_values") >= 2))
    return out.join(sample_values(values), "field", "left").withColumn(
        "sample_values", F.coalesce("sample_values", F.array().cast("array<string>"))
    )


def with_sources(quality: DataFrame, plan: FieldPlan) -> DataFrame:
    rows = [(f, plan.columns.get(f), plan.methods.get(f)) for f in lx.AUDIT_FIELDS]
    sources = quality.sparkSession.createDataFrame(rows, "field string, source_column string, selection_method string")
    return quality.join(sources, "field", "left")


def _level(strong: Column, partial: Column) -> Column:
    return F.when(strong, "strong").when(partial, "partial").otherwise("weak")


def readiness(quality: DataFrame, explicit_source: str | None = None) -> DataFrame:
    """One row from the field table: coverage lists, three support levels, warnings."""
    found = F.col("available_in_canonical") & (F.col("missing_share") < 1.0)
    good = F.col("informative")
    context = F.col("field").isin(lx.CONTEXT_FIELDS)
    lists = quality.agg(
        names_where("field", found).alias("detected_fields"), names_where("field", ~found).alias("missing_fields"),
        names_where("field", good).alias("informative_fields"), names_where("field", ~good).alias("non_informative_fields"),
        names_where("field", good & context).alias("context_informative"),
        names_where("field", found & context).alias("context_available"),
    )

    def has(field: str) -> Column:
        return F.array_contains("informative_fields", field)

    def lost(field: str) -> Column:
        return F.array_contains("missing_fields", field)

    levels = lists.withColumns({
        "explicit_sequence_available": F.lit(bool(explicit_source)),
        "segmentation_readiness": _level(has("sequence_id") & (F.size("context_informative") >= 2), has("sequence_id")),
        "temporal_readiness": _level(has("episode_time_sec") & has("pause_time_sec"), has("episode_time_sec") | has("pause_time_sec")),
        "semantic_readiness": _level(has("weight_class") & has("sequence_id"), has("weight_class") | has("sequence_id")),
        "episode_time_informative": has("episode_time_sec"),
        "pause_time_informative": has("pause_time_sec"),
        "weight_class_informative": has("weight_class"),
    })
    return levels.withColumn("warnings", codes_where(
        weight_class_weak=~has("weight_class"), episode_time_weak=~has("episode_time_sec"), pause_time_weak=~has("pause_time_sec"),
        opponent_name_missing=lost("opponent_name"), tournament_name_missing=lost("tournament_name"),
        event_date_missing=lost("event_date"), segmentation_weak=F.col("segmentation_readiness") == "weak",
    ))


def audit(df: DataFrame, plan: FieldPlan | None = None) -> dict[str, DataFrame]:
    quality = park(field_quality(df), "fields")  # a row per field, read by every part below
    coverage = with_sources(quality, plan) if plan else quality
    rows = df.agg(F.count(F.lit(1)).alias("rows_total"))
    explicit = plan.columns.get("explicit_sequence_id") if plan else None
    return {"field_coverage": coverage, "summary": beside(readiness(quality, explicit), rows)}
