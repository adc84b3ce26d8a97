"""Time series from CSV, with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASHFLOW = (
    "date string, cash_inflow double, overdue_ratio double, avg_payment_delay_days double, contract_terms_index double, true_state string"
)


def read_series(spark: SparkSession, path: str, schema: str = CASHFLOW, series_id: str | None = None) -> DataFrame:
    """Rows of a CSV with header; `yyyy-MM` dates become the first of the month.

    One file is one series unless the schema has a series column.
    """
    df = spark.read.schema(schema).csv(path, header=True)
    if "date" in df.columns:
        text = F.col("date").cast("string")
        whole = F.when(F.length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(text)
        df = df.withColumn("date", F.to_date(whole)).withColumn("t", (F.year("date") * 12 + F.month("date")).cast("long"))
    return df.withColumn("series_id", F.lit(series_id)) if series_id is not None else df
