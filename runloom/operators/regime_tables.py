"""Labels and event matches for decoded series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Ordering, with_previous

# --- fixed values: label thresholds -----------------------------------------------
CASH_BANDS = [(85, "NORMAL"), (65, "MODERATE DECLINE"), (None, "SIGNIFICANT DECLINE")]
OVERDUE_BANDS = [(0.1, "Low overdue"), (0.25, "Moderate overdue"), (None, "High overdue")]
DELAY_BANDS = [(25, "Quick payments"), (40, "Moderate delays"), (None, "Significant delays")]
TERMS_BANDS = [(40, "Favorable terms"), (70, "Moderate terms"), (None, "Unfavorable terms")]
RARE_STATE = 0.05


def _band(value: Column, bands: list, above: bool = False) -> Column:
    out = None
    for limit, text in bands:
        if limit is None:
            return out.otherwise(text)
        test = value > limit if above else value < limit
        out = F.when(test, text) if out is None else out.when(test, text)
    raise ValueError("bands need an open end")


def payment_regimes(df: DataFrame, *keys: str, cash: str = "cash_inflow", overdue: str = "overdue_ratio",
                    delay: str = "avg_payment_delay_days", terms: str = "contract_terms_index") -> DataFrame:
    """Means of the four measures per state, and the label they give."""
    out = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in (cash, overdue, delay, terms)], F.count(F.lit(1)).alias("rows"))
    label = F.concat(
        _band(F.col(cash), CASH_BANDS, above=True), F.lit(" - "), _band(F.col(overdue), OVERDUE_BANDS), F.lit(", "),
        _band(F.col(delay), DELAY_BANDS), F.lit(", "), _band(F.col(terms), TERMS_BANDS),
    )
    return out.withColumn("interpretation", label)


def trade_regimes(df: DataFrame, *keys: str, trade: str, balance: str, oil: str, period: str) -> DataFrame:
    """Means per state, one of five labels, and the distinct periods spent in it."""
    t, b, o = F.col("avg_trade"), F.col("avg_balance"), F.col("avg_oil")
    out = df.groupBy(*keys).agg(
        F.avg(trade).alias("avg_trade"), F.avg(balance).alias("avg_balance"), F.avg(oil).alias("avg_oil"),
        F.array_sort(F.collect_set(period)).alias("periods"),  # distinct years
    )
    label = (
        F.when((o > 60) & (t > 600) & (b > 0), "normal")
        .when((o > 60) & ~(t > 600), "sanctions_pressure")
        .when(~(o > 60) & (b < -20), "price_shock")
        .when((t > 600) & ~(b > 0), "structural_shift")
        .otherwise("transition")
    )
    return out.withColumn("interpretation", label)


def growth_regimes(df: DataFrame, *keys: str, state: str, turnover: str, balance: str) -> DataFrame:
    """Growth, crisis or stagnation against the mean of the state means; rare states flagged."""
    per = df.groupBy(*keys, state).agg(F.avg(turnover).alias("mean_turnover"), F.avg(balance).alias("mean_balance"), F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(*keys)  # one row per state
    middle = F.avg("mean_turnover").over(w)
    label = (
        F.when((F.col("mean_turnover") > middle) & (F.col("mean_balance") > 0), "growth")
        .when((F.col("mean_turnover") < middle) & (F.col("mean_balance") < 0), "crisis")
        .otherwise("stagnation")
    )
    return per.withColumns({"label": label, "rare": F.col("rows") / F.sum("rows").over(w) < RARE_STATE})


def near_events(df: DataFrame, events: DataFrame, date: str = "date", event_date: str = "event_date", months: int = 1) -> DataFrame:
    """Rows within so many months of an event, with a mark on the day itself.

    A range join turned into an equi-join: both sides carry the month number, and
    each event is listed under every month its window touches.
    """
    first, last = F.add_months(event_date, -months), F.add_months(event_date, months)

    def month(d: Column) -> Column:
        return F.year(d) * 12 + F.month(d)

    listed = events.withColumns({"_first": first, "_last": last}).withColumn(
        "_month", F.explode(F.sequence(month(F.col("_first")), month(F.col("_last"))))
    )
    rows = df.withColumn("_month", month(F.col(date)))
    found = rows.join(listed, "_month").where(F.col(date).between(F.col("_first"), F.col("_last")))
    return found.withColumn("is_event", F.col(date) == F.col(event_date)).drop("_month", "_first", "_last")


def label_events(df: DataFrame, events: DataFrame, period: str, text: str = "description") -> DataFrame:
    """Event text by equal period; '' where none."""
    return df.join(events, period, "left").withColumn(text, F.coalesce(text, F.lit("")))


def changes_at_events(df: DataFrame, events: DataFrame, key: str, period: str, state: str = "hidden_state") -> DataFrame:
    """Event periods where the state differs from the period before."""
    order = Ordering((key,), period).inspect(df)
    moved = with_previous(df.select(key, period, state), order, [state], "prev_")
    return moved.where(F.col(f"prev_{state}") != F.col(state)).join(events, period)
