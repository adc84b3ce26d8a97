"""Value frequencies and mapping counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce
from .tables import top_per_key, unpivot


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per (column, text value); blanks do not count."""
    long = unpivot(df, {c: coerce.strip(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in columns}, name="column_name")
    return long.where(F.col("value") != "").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("rows"))


def top_values(counts: DataFrame, k: int = 12) -> DataFrame:
    return top_per_key(counts, ["column_name"], k, F.desc("rows"), "value")


def distinct_values(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"))


def signal_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-empty and positive rows and shares per column, in one pass."""
    cells = {
        c: F.struct(coerce.is_filled(F.col(f"`{c}`")).alias("filled"), coerce.is_positive(F.col(f"`{c}`")).alias("positive"))
        for c in columns
    }
    long = unpivot(df, cells, name="column_name")
    return long.groupBy("column_name").agg(
        F.count(F.when(F.col("value.filled"), 1)).alias("non_empty_rows"),
        F.count(F.when(F.col("value.positive"), 1)).alias("positive_rows"),
        coerce.share(F.col("value.filled")).alias("non_empty_share"),
        coerce.share(F.col("value.positive")).alias("positive_share"),
    )


def bridge_source() -> Column:
    """Text that says which evidence led to the class."""
    how = F.col("observation_resolution_type")
    classes, columns = F.col("finish_match_classes"), F.col("finish_match_columns")
    return (
        F.when((how == "direct_finish_signal") & (F.size(classes) > 0),
               F.concat(F.lit("finish:"), F.array_join(F.array_sort(F.array_distinct(classes)), "+")))
        .when((how == "direct_finish_signal") & (F.size(columns) > 0),
              F.concat(F.lit("finish_col:"), F.array_join(F.slice(F.array_sort(F.array_distinct(columns)), 1, 3), "|")))
        .when(how == "direct_finish_signal", "finish:detected")
        .when((how == "inferred_from_score") & F.col("score_rounded").isNotNull(),
              F.concat(F.lit("score:"), F.col("score_rounded").cast("string")))
        .when(how == "inferred_from_score", "score:unknown")
        .when(how == "no_score_rule", "score:0")
        .otherwise(F.concat(how, F.lit(":"), F.coalesce("observation_quality_flag", F.lit("unknown"))))
    )


def mapping_crosstab(df: DataFrame) -> DataFrame:
    """Rows and share per evidence, resolution and class."""
    counts = df.groupBy(bridge_source().alias("bridge_source"), "observation_resolution_type", "observed_zap_class").agg(
        F.count(F.lit(1)).alias("rows")
    )
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(F.lit(1))))


def finish_match_counts(df: DataFrame) -> DataFrame:
    """Rows with a direct finish per class and per source column."""
    direct = df.where(F.col("observation_resolution_type") == "direct_finish_signal")
    by = F.explode(F.concat(
        F.array(F.struct(F.lit("class").alias("kind"), F.col("observed_zap_class").alias("name"))),
        F.transform("finish_match_columns", lambda c: F.struct(F.lit("column").alias("kind"), c.alias("name"))),
    ))
    return direct.select(by.alias("m")).groupBy("m.kind", "m.name").agg(F.count(F.lit(1)).alias("rows"))


def reason_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).alias("reason")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "reason").limit(k)
