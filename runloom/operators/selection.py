"""Exact top-n cuts without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 64


def nth_largest(df: DataFrame, values: dict[str, Column], n: dict[str, int]) -> dict[str, float | None]:
    """The n-th largest value of each column; null values do not count.

    Each pass is one aggregate job that counts 64 bins per column and then looks
    into the one bin that holds the answer, until that bin has a single value.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), c.cast("double").alias("value")) for v, c in values.items()]))
    work = df.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull())
    value = F.col("value")
    measures = (F.count(value).alias("rows"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    answer: dict[str, float | None] = dict.fromkeys(values)
    open_: dict[str, tuple[float, float, int]] = {}
    for r in work.groupBy("name").agg(*measures).collect():  # one row per column
        if r["rows"] < n[r["name"]] or r["lo"] == r["hi"]:
            answer[r["name"]] = r["lo"]  # too few rows: take all of them
        else:
            open_[r["name"]] = (r["lo"], r["hi"], n[r["name"]])
    while open_:
        bin_ = F.lit(None).cast("long")
        for v, (lo, hi, _) in open_.items():
            place = F.least(F.floor((value - F.lit(lo)) / F.lit((hi - lo) / BINS)), F.lit(BINS - 1))
            bin_ = F.when((F.col("name") == v) & value.between(lo, hi), place).otherwise(bin_)
        bins = work.withColumn("bin", bin_).where(F.col("bin").isNotNull()).groupBy("name", "bin").agg(*measures)
        rows = sorted(bins.collect(), key=lambda r: -r["bin"])  # 64 rows per column at most
        for v in list(open_):
            _, _, left = open_.pop(v)
            for r in (r for r in rows if r["name"] == v):
                if left <= r["rows"]:
                    if r["lo"] == r["hi"] or (r["hi"] - r["lo"]) / BINS == 0.0:
                        answer[v] = r["lo"]
                    else:
                        open_[v] = (r["lo"], r["hi"], left)
                    break
                left -= r["rows"]
    return answer


def mean_of_top(df: DataFrame, value: Column, n: int, columns: list[str], threshold: float) -> list[float]:
    """Column means over the n rows with the largest value, `threshold` being the n-th.

    Rows tied at the threshold share the remaining places equally.
    """
    above, at = value > threshold, value == threshold
    row = df.agg(
        F.count(F.when(above, 1)).alias("n_above"), F.count(F.when(at, 1)).alias("n_at"),
        *[F.sum(F.when(above, F.col(c))).alias(f"s_{i}") for i, c in enumerate(columns)],
        *[F.avg(F.when(at, F.col(c))).alias(f"t_{i}") for i, c in enumerate(columns)],
    ).first()
    taken = min(n, row["n_above"] + row["n_at"])
    rest = taken - row["n_above"]
    return [((row[f"s_{i}"] or 0.0) + rest * (row[f"t_{i}"] or 0.0)) / taken for i in range(len(columns))]
