"""Regimes in many time series: Gaussian models per series, choice and checks.

All series, state counts and seeds are fitted together (`fits`), whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import Ordering, with_place
from . import fits
from .runs import SEGMENT

PARAMETER_COUNTS = ("full_square", "free", "spherical")


def parameter_count(n: int, d: int, rule: str, covariance: str = "full") -> int:
    """Number of free parameters, in three ways of counting."""
    if rule == "spherical":
        return (n - 1) + n * d + n
    spread = n * d * (d + 1) // 2 if covariance == "full" or rule == "free" else n * d
    if rule == "full_square":
        return n * n + n * d + spread
    if rule == "free":
        return n * (n - 1) + (n - 1) + n * d + spread
    raise ValueError(f"unknown counting rule {rule!r}")


@dataclass(frozen=True)
class SeriesTable:
    """Rows of many series: key, order column and feature columns; `segment` rows lie together in a task."""

    df: DataFrame
    key: str
    order: str
    features: list[str]
    segment: int = SEGMENT

    def scaled(self) -> DataFrame:
        """Zero mean and unit population deviation per series; a flat feature stays 0."""
        stats = self.df.groupBy(self.key).agg(
            *[F.avg(c).alias(f"_m_{c}") for c in self.features], *[F.stddev_pop(c).alias(f"_s_{c}") for c in self.features]
        )
        joined = self.df.join(stats, self.key)
        unit = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in self.features}
        return joined.select(self.key, F.col(self.order).cast("long").alias(self.order), *[x.alias(c) for c, x in unit.items()])

    def held(self, rows: DataFrame, *more: str) -> fits.Series:
        return fits.hold(rows, (self.key, *more), self.order, self.features, self.segment)


def fit_grid(table: SeriesTable, states: list[int], seeds: list[int] = (42,), covariance: str = "full", max_iter: int = 200,
             tol: float = 1e-4) -> DataFrame:
    """Log-likelihood of every (series, state count, seed); a failed fit has none, and says so in `status`."""
    series = table.held(table.scaled())
    found = fits.fitted(series, [(n, seed) for n in states for seed in seeds], covariance, fits.Rules(max_iter, tol))

    def count(rule: str):
        kinds = [(n, kind, parameter_count(n, series.width, rule, kind)) for n in states for kind in dict.fromkeys((covariance, "diag"))]
        out = None
        for n, kind, size in kinds:
            fits_here = (F.col("n_states") == n) & (F.col("covariance") == kind)
            out = F.when(fits_here, size) if out is None else out.when(fits_here, size)
        return out.cast("int").alias(f"n_params_{rule}")

    return found.select(
        table.key, "n_states", "seed", "covariance", "log_likelihood", "n_rows", *[count(rule) for rule in PARAMETER_COUNTS],
        F.col("phase").alias("status"),
    )


def with_criteria(grid: DataFrame, rule: str = "full_square") -> DataFrame:
    """AIC and BIC with the chosen way of counting, and the overfitting warning."""
    k, ll = F.col(f"n_params_{rule}"), F.col("log_likelihood")
    return grid.withColumns({
        "n_params": k, "aic": -2 * ll + 2 * k, "bic": -2 * ll + k * F.log(F.col("n_rows").cast("double")),
        "overfit_risk": k >= F.col("n_rows"),
    }).drop(*[f"n_params_{r}" for r in PARAMETER_COUNTS])


def choose_states(criteria: DataFrame, key: str) -> DataFrame:
    """State count with the lowest BIC per series; fewer states win a tie. Null where every fit failed."""
    order = F.when(F.col("bic").isNotNull(), F.struct("bic", "n_states"))
    return criteria.groupBy(key).agg(F.min_by("n_states", order).alias("n_states"), F.min("bic").alias("bic"))


def bic_elbow(criteria: DataFrame, key: str) -> DataFrame:
    """State count where BIC bends most: the largest second difference.

    One entry per state count and series, so the windows are tiny.
    """
    w = Window.partitionBy(key).orderBy("n_states")
    bend = F.lead("bic").over(w) - 2 * F.col("bic") + F.lag("bic").over(w)
    found = criteria.withColumn("bend", bend).where(F.col("bend").isNotNull())
    return found.groupBy(key).agg(F.max_by("n_states", F.struct("bend", -F.col("n_states"))).alias("elbow"), F.max("bend").alias("bend"))


def stability(grid: DataFrame, *keys: str) -> DataFrame:
    """Spread of the log-likelihood over seeds, and two instability flags."""
    ll = F.col("log_likelihood")
    out = grid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(ll).alias("mean"), F.stddev_pop(ll).alias("std"), F.min(ll).alias("min"), F.max(ll).alias("max")
    )
    cv = F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")).otherwise(0.0)
    return out.withColumn("cv", cv).withColumn("unstable", F.col("cv") > 0.10).withColumn(
        "very_unstable", F.col("std") > 0.2 * F.abs("mean")
    )


def best_runs(grid: DataFrame, *keys: str) -> DataFrame:
    """The seed with the highest log-likelihood; the lowest seed wins a tie."""
    return grid.groupBy(*keys).agg(
        F.max_by("seed", F.when(F.col("log_likelihood").isNotNull(), F.struct("log_likelihood", -F.col("seed")))).alias("seed"), F.max("log_likelihood").alias("log_likelihood")
    )


def decode_series(table: SeriesTable, n: int, covariance: str = "full", seed: int = 42, max_iter: int = 200, tol: float = 1e-4) -> DataFrame:
    """Fit each series and decode it: (key, order, state, posteriors, confidence). Rows of failed fits stay, without a state."""
    series = table.held(table.scaled())
    state = fits.fitted(series, [(n, seed)], covariance, fits.Rules(max_iter, tol))
    posteriors = [f"p_state_{i}" for i in range(n)]
    rows = fits.decoded(series, state, n, table.order)
    return rows.withColumn("confidence", F.greatest(*posteriors) if n > 1 else F.col(posteriors[0]))


def temporal_split(df: DataFrame, key: str, order: str, ratio: float = 0.8) -> DataFrame:
    """Mark the first ⌊ratio·n⌋ rows of each series as training rows."""
    rows = with_place(df, Ordering((key,), order).inspect(df), "_place", "_total")
    return rows.withColumn("is_train", F.col("_place") <= F.floor(F.col("_total") * ratio)).drop("_place", "_total")


HEAD, WHOLE, TAIL = range(3)


def temporal_validation(table: SeriesTable, n: int, ratio: float = 0.8, covariance: str = "full", seed: int = 42, max_iter: int = 200,
                        tol: float = 1e-4) -> DataFrame:
    """Log-likelihood of each series' tail under a model of its head and of the whole.

    Head, whole and tail are series of their own (`_part`), so that heads and wholes
    are fitted together. A series stays, with nulls, where a fit fails.
    """
    key = table.key
    split = temporal_split(table.scaled(), key, table.order, ratio)
    parts = F.when(F.col("is_train"), F.array(F.lit(HEAD), F.lit(WHOLE))).otherwise(F.array(F.lit(WHOLE), F.lit(TAIL)))
    split = split.withColumn("_part", F.explode(parts))
    held = table.held(split.where(F.col("_part") != TAIL), "_part")
    state = fits.fitted(held, [(n, seed)], covariance, fits.Rules(max_iter, tol))
    tails = table.held(split.where(F.col("_part") == TAIL))
    score = fits.scores(tails, state, ["_part"])
    of = lambda part, column: F.max(F.when(F.col("_part") == part, F.col(column)))  # noqa: E731  one row each
    fitted = state.groupBy(key).agg(of(HEAD, "log_likelihood").alias("train_ll"), F.count("log_likelihood").alias("_n"))
    scored = score.groupBy(key).agg(of(HEAD, "log_likelihood").alias("tail_ll_train_only"), of(WHOLE, "log_likelihood").alias("tail_ll_full"))
    out = fitted.join(scored, key, "left")
    kept = [F.when(F.col("_n") == 2, F.col(c)).alias(c) for c in ("train_ll", "tail_ll_train_only", "tail_ll_full")]
    return out.select(key, *kept).withColumn("gain", F.col("tail_ll_full") - F.col("tail_ll_train_only")).withColumn(
        "overfit", F.col("train_ll") - F.col("tail_ll_train_only") > 10
    )
