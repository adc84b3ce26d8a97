"""Queries: regimes in the daily series of each event type."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..models import regimes
from ..operators import charts, regime_tables as rt
from ..session import shared_folder
from ..sources import series
from . import em_sql, q_models
from .binding import table, view, with_cte
from .registry import query

FEATURES = ["total", "events", "average", "spread"]
_DAYS = """
d AS (
  SELECT event_type AS series_id, CAST(ts AS DATE) AS day, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS t,
    sum(value) AS total, CAST(count(*) AS DOUBLE) AS events, avg(value) AS average, coalesce(stddev_pop(value), 0) AS spread
  FROM events GROUP BY 1, 2, 3
)"""
# a state per day that needs no model: by the day's mean value
_STATE = "CAST(CASE WHEN average < 47 THEN 0 WHEN average < 52 THEN 1 ELSE 2 END AS INTEGER)"
_STATES = _DAYS + f""",
s AS (SELECT *, {_STATE} AS hidden_state FROM d)"""


@view
def daily(spark, sf):
    day = F.to_date("ts")
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("series_id"), day.alias("day")).agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).cast("double").alias("events"), F.avg("value").alias("average"),
        F.stddev_pop("value").alias("spread"),
    ).withColumn("t", F.unix_date("day").cast("long"))


def _table(spark, sf):
    return regimes.SeriesTable(daily(spark, sf), "series_id", "t", FEATURES)


def _with_states(spark, sf):
    return daily(spark, sf).withColumn("hidden_state", F.expr(_STATE))


def _events(spark, sf):
    """Days with more events of all types than the mean day, as events."""
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("event_date")).agg(F.count(F.lit(1)).alias("n"))
    busy = days.where(F.col("n") > days.agg(F.avg("n")).scalar())
    return busy.select("event_date", F.concat(F.lit("busy "), F.col("event_date").cast("string")).alias("description"))


_EVENTS = """,
ev AS (SELECT event_date, 'busy ' || strftime(event_date, '%Y-%m-%d') AS description FROM (
  SELECT CAST(ts AS DATE) AS event_date, count(*) AS n FROM events GROUP BY 1) QUALIFY n > avg(n) OVER ())"""


@query("s11_daily_series_csv", with_cte(_DAYS, "SELECT series_id, count(*) AS days, round(sum(total), 4) AS total FROM d GROUP BY 1"))
def series_csv(spark, sf):
    """The daily series written as CSV and read back with a fixed schema."""
    path = f"{shared_folder(spark)}/runloom/series-{os.urandom(6).hex()}"
    daily(spark, sf).select("series_id", "day", "total").write.csv(path, header=True)
    rows = series.read_series(spark, path, "series_id string, day date, total double")
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("days"), F.round(F.sum("total"), 4).alias("total"))


@query("w9_temporal_split", with_cte(_DAYS, """
, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS p, count(*) OVER (PARTITION BY series_id) AS n FROM d)
SELECT series_id, t, p <= floor(n * 0.8) AS is_train FROM r"""))
def temporal_split(spark, sf):
    return regimes.temporal_split(daily(spark, sf), "series_id", "t").select("series_id", "t", "is_train")


@query("w7_changes_at_events", with_cte(_STATES + _EVENTS, """
, g AS (SELECT *, lag(hidden_state) OVER (PARTITION BY series_id ORDER BY t) AS before FROM s)
SELECT series_id, t, before AS prev_hidden_state, hidden_state, description FROM g JOIN ev ON g.day = ev.event_date WHERE before <> hidden_state"""))
def changes_at_events(spark, sf):
    events = _events(spark, sf).select(F.unix_date("event_date").cast("long").alias("t"), "description")
    out = rt.changes_at_events(_with_states(spark, sf), events, "series_id", "t")
    return out.select("series_id", "t", "prev_hidden_state", "hidden_state", "description")


@query("j4_rows_near_events", with_cte(_STATES + _EVENTS, """
SELECT series_id, day, description, hidden_state, day = event_date AS is_event FROM s JOIN ev
  ON day BETWEEN event_date - INTERVAL 1 MONTH AND event_date + INTERVAL 1 MONTH"""))
def rows_near_events(spark, sf):
    out = rt.near_events(_with_states(spark, sf), _events(spark, sf), "day")
    return out.select("series_id", "day", "description", "hidden_state", "is_event")


@query("j5_event_labels", with_cte(_STATES + _EVENTS, """
SELECT series_id, day, coalesce(description, '') AS description FROM s LEFT JOIN ev ON day = event_date"""))
def event_labels(spark, sf):
    events = _events(spark, sf).withColumnRenamed("event_date", "day")
    return rt.label_events(_with_states(spark, sf), events, "day").select("series_id", "day", "description")


_A22 = """
SELECT series_id, hidden_state, count(*) AS rows, round(avg(average * 1.5), 6) AS cash_inflow,
  CASE WHEN avg(average * 1.5) > 85 THEN 'NORMAL' WHEN avg(average * 1.5) > 65 THEN 'MODERATE DECLINE' ELSE 'SIGNIFICANT DECLINE' END || ' - ' ||
  CASE WHEN avg(spread / 100) < 0.1 THEN 'Low overdue' WHEN avg(spread / 100) < 0.25 THEN 'Moderate overdue' ELSE 'High overdue' END || ', ' ||
  CASE WHEN avg(events) < 25 THEN 'Quick payments' WHEN avg(events) < 40 THEN 'Moderate delays' ELSE 'Significant delays' END || ', ' ||
  CASE WHEN avg(average) < 40 THEN 'Favorable terms' WHEN avg(average) < 70 THEN 'Moderate terms' ELSE 'Unfavorable terms' END AS interpretation
FROM s GROUP BY 1, 2"""


@query("a22_payment_regimes", with_cte(_STATES, _A22))
def payment_regimes(spark, sf):
    rows = _with_states(spark, sf).selectExpr(
        "series_id", "hidden_state", "average * 1.5 AS cash_inflow", "spread / 100 AS overdue_ratio", "events AS avg_payment_delay_days",
        "average AS contract_terms_index"
    )
    out = rt.payment_regimes(rows, "series_id", "hidden_state")
    return out.select("series_id", "hidden_state", "rows", F.round("cash_inflow", 6).alias("cash_inflow"), "interpretation")


@query("a23_trade_regimes", with_cte(_STATES, """
SELECT hidden_state, round(avg(total), 6) AS avg_trade, CASE
  WHEN avg(average * 1.25) > 60 AND avg(total) > 600 AND avg(average - 48) > 0 THEN 'normal'
  WHEN avg(average * 1.25) > 60 AND NOT avg(total) > 600 THEN 'sanctions_pressure'
  WHEN NOT avg(average * 1.25) > 60 AND avg(average - 48) < -20 THEN 'price_shock'
  WHEN avg(total) > 600 AND NOT avg(average - 48) > 0 THEN 'structural_shift' ELSE 'transition' END AS interpretation,
  count(DISTINCT t // 30) AS n_periods FROM s GROUP BY 1"""))
def trade_regimes(spark, sf):
    rows = _with_states(spark, sf).selectExpr(
        "hidden_state", "total", "average - 48 AS balance", "average * 1.25 AS oil", "t div 30 AS period"
    )
    out = rt.trade_regimes(rows, "hidden_state", trade="total", balance="balance", oil="oil", period="period")
    return out.select("hidden_state", F.round("avg_trade", 6).alias("avg_trade"), "interpretation", F.size("periods").cast("long").alias("n_periods"))


@query("a24_growth_regimes", with_cte(_STATES, """
, p AS (SELECT series_id, hidden_state, avg(total) AS mt, avg(average - 48) AS mb, count(*) AS rows FROM s GROUP BY 1, 2),
q AS (SELECT *, avg(mt) OVER (PARTITION BY series_id) AS mid, sum(rows) OVER (PARTITION BY series_id) AS n FROM p)
SELECT series_id, hidden_state, CASE WHEN mt > mid AND mb > 0 THEN 'growth' WHEN mt < mid AND mb < 0 THEN 'crisis' ELSE 'stagnation' END AS label,
  rows / n < 0.05 AS rare FROM q"""))
def growth_regimes(spark, sf):
    rows = _with_states(spark, sf).withColumn("balance", F.col("average") - 48)
    out = rt.growth_regimes(rows, "series_id", state="hidden_state", turnover="total", balance="balance")
    return out.select("series_id", "hidden_state", "label", "rare")


# run statistics from a table of runs: here every user is a run and its value total the likelihood
_RUNS = "r AS (SELECT event_type AS series_id, user_id AS seed, -sum(value) AS log_likelihood FROM events GROUP BY 1, 2)"


def _runs(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("series_id"), F.col("user_id").alias("seed")).agg(
        (-F.round(F.sum("value"), 6)).alias("log_likelihood")
    )


@query("a25_run_stability", with_cte(_RUNS.replace("-sum(value)", "-round(sum(value), 6)"), """
SELECT series_id, count(*) AS runs, round(avg(log_likelihood), 4) AS mean, round(stddev_pop(log_likelihood), 4) AS std,
  round(stddev_pop(log_likelihood) / abs(avg(log_likelihood)), 6) AS cv, stddev_pop(log_likelihood) / abs(avg(log_likelihood)) > 0.1 AS unstable
FROM r GROUP BY 1"""))
def run_stability(spark, sf):
    out = regimes.stability(_runs(spark, sf), "series_id")
    return out.select("series_id", "runs", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("cv", 6).alias("cv"), "unstable")


@query("t7_best_run", with_cte(_RUNS.replace("-sum(value)", "-round(sum(value), 6)"), """
SELECT series_id, seed, round(log_likelihood, 4) AS log_likelihood FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY log_likelihood DESC, seed) AS p FROM r) WHERE p = 1"""))
def best_run(spark, sf):
    return regimes.best_runs(_runs(spark, sf), "series_id").withColumn("log_likelihood", F.round("log_likelihood", 4))


@query("w8_bic_elbow", with_cte("""
g AS (SELECT event_type AS series_id, user_id % 7 AS n_states, round(sum(value), 4) AS bic FROM events GROUP BY 1, 2),
b AS (SELECT *, lead(bic) OVER w - 2 * bic + lag(bic) OVER w AS bend FROM g WINDOW w AS (PARTITION BY series_id ORDER BY n_states))""", """
SELECT series_id, n_states AS elbow FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY bend DESC, n_states) AS p
  FROM b WHERE bend IS NOT NULL) WHERE p = 1"""))
def bic_elbow(spark, sf):
    grid = table(spark, sf, "events").groupBy(F.col("event_type").alias("series_id"), (F.col("user_id") % 7).alias("n_states")).agg(
        F.round(F.sum("value"), 4).alias("bic")
    )
    return regimes.bic_elbow(grid, "series_id").select("series_id", "elbow")


@query("v7_regime_means", with_cte(_STATES, """
SELECT hidden_state, round(avg(total), 6) AS total, round(avg(spread), 6) AS spread FROM s GROUP BY 1"""))
def regime_means(spark, sf):
    out = charts.regime_means(_with_states(spark, sf), ["total", "spread"], "hidden_state")
    return out.select("hidden_state", F.round("total", 6).alias("total"), F.round("spread", 6).alias("spread"))


@query("v8_transition_cells", q_models._recursive(q_models.trained_sql(True), """
SELECT 'trained' AS model_id, CAST(k // 3 AS INT) AS from_state, CAST(k % 3 AS INT) AS to_state, round(value, 4) AS probability
FROM (SELECT unnest(range(0, 9)) AS k, unnest(t) AS value FROM last)"""))
def transition_cells(spark, sf):
    cells = charts.transition_cells(q_models.trained_model(spark, sf))
    return cells.withColumn("probability", F.round("probability", 4))


# --- fits: the twins run the whole EM in SQL -------------------------------------------------

_D = len(FEATURES)
#: EM turns that most twins write out; no fit of the given series takes more.
_TURNS = 40
_ONE = "CASE WHEN stddev_pop({0}) OVER w > 0 THEN stddev_pop({0}) OVER w ELSE 1 END"
_SCALED = _DAYS + ",\nz AS (SELECT series_id AS key, t, " + ", ".join(
    f"({c} - avg({c}) OVER w) / {_ONE.format(c)} AS x{i}" for i, c in enumerate(FEATURES)
) + " FROM d WINDOW w AS (PARTITION BY series_id))"


def _em(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def _rounded(*columns):
    return [F.round(c, 4).alias(c) for c in columns]


@query("h25_regime_states", _em(_SCALED, em_sql.fitted("z", [(2, 42)], "full", _D, 200, _TURNS), em_sql.decoded(_D), select=f"""
SELECT key AS series_id, t, any_value(s.k) AS hidden_state, round(max(g) FILTER (y.k = 0), 4) AS p_state_0, round(max(g) FILTER (y.k = 1), 4) AS p_state_1,
  round(max(g), 4) AS confidence
FROM yF y JOIN numbered r USING (key, u) JOIN path s ON {em_sql.same("s", "y", "u")} GROUP BY key, t"""))
def regime_states(spark, sf):
    out = regimes.decode_series(_table(spark, sf), 2)
    return out.select("series_id", "t", "hidden_state", *_rounded("p_state_0", "p_state_1", "confidence"))


_GRID = em_sql.fitted("z", [(n, 42) for n in range(2, 9)], "full", _D, 200, _TURNS)
_PARAMS = f"n * n + n * {_D} + n * {_D * (_D + 1) // 2}"


def _criteria(spark, sf):
    return regimes.with_criteria(regimes.fit_grid(_table(spark, sf), list(range(2, 9))))


@query("h26_model_choice", _em(_SCALED, _GRID, select=f"""
SELECT series_id, CAST(n AS INT) AS n_states, round(bic, 4) AS bic FROM (
  SELECT key AS series_id, n, -2 * ll + ({_PARAMS}) * ln(n_rows) AS bic FROM fit)
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY bic, n) = 1"""))
def model_choice(spark, sf):
    return regimes.choose_states(_criteria(spark, sf), "series_id").withColumn("bic", F.round("bic", 4))


@query("h26_criteria", _em(_SCALED, _GRID, select=f"""
SELECT key AS series_id, CAST(n AS INT) AS n_states, round(ll, 4) AS log_likelihood, CAST({_PARAMS} AS INT) AS n_params,
  round(-2 * ll + 2 * ({_PARAMS}), 4) AS aic, round(-2 * ll + ({_PARAMS}) * ln(n_rows), 4) AS bic, {_PARAMS} >= n_rows AS overfit_risk FROM fit"""))
def criteria(spark, sf):
    """Likelihood, AIC and BIC of every series and state count."""
    return _criteria(spark, sf).select("series_id", "n_states", "n_params", "overfit_risk", *_rounded("log_likelihood", "aic", "bic"))


_HEADS = """place AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) <= floor(count(*) OVER (PARTITION BY key) * 0.8) AS head FROM z),
parts AS (SELECT * REPLACE (key || ' head' AS key) FROM place WHERE head UNION ALL SELECT * REPLACE (key || ' whole' AS key) FROM place),
tails AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS u FROM place WHERE NOT head)"""


@query("h27_temporal_validation", _em(
    _SCALED, _HEADS, em_sql.fitted("parts", [(2, 42)], "full", _D, 200, 100), *em_sql.forward("tails", "F", _D, "tail"), select="""
SELECT series_id, round(train, 4) AS train_ll, round(head, 4) AS tail_ll_train_only, round(whole, 4) AS tail_ll_full, round(whole - head, 4) AS gain,
  train - head > 10 AS overfit
FROM (SELECT split_part(f.key, ' ', 1) AS series_id, max(f.ll) FILTER (ends_with(f.key, ' head')) AS train, max(t.ll) FILTER (ends_with(f.key, ' head')) AS head,
  max(t.ll) FILTER (ends_with(f.key, ' whole')) AS whole FROM fit f JOIN lltailF t USING (key, n, seed) GROUP BY 1)"""))
def temporal_validation(spark, sf):
    out = regimes.temporal_validation(_table(spark, sf), 2)
    return out.select("series_id", *_rounded("train_ll", "tail_ll_train_only", "tail_ll_full", "gain"), "overfit")


_STARTS = em_sql.fitted("z", [(3, seed) for seed in range(20)], "spherical", _D, 100, 100)


def _starts(spark, sf):
    return regimes.fit_grid(_table(spark, sf), [3], list(range(20)), "spherical", 100)


@query("h28_multi_start", _em(_SCALED, _STARTS, select="""
SELECT *, cv > 0.1 AS unstable, std > 0.2 * abs(mean) AS very_unstable FROM (
  SELECT key AS series_id, CAST(n AS INT) AS n_states, count(*) AS runs, round(avg(ll), 4) AS mean, round(stddev_pop(ll), 4) AS std,
    round(min(ll), 4) AS min, round(max(ll), 4) AS max, round(stddev_pop(ll) / abs(avg(ll)), 4) AS cv FROM fit GROUP BY 1, 2)"""))
def multi_start(spark, sf):
    out = regimes.stability(_starts(spark, sf), "series_id", "n_states")
    return out.select("series_id", "n_states", "runs", *_rounded("mean", "std", "min", "max", "cv"), "unstable", "very_unstable")


@query("h28_best_start", _em(_SCALED, _STARTS, select="""
SELECT key AS series_id, round(max(ll), 4) AS log_likelihood, count(*) AS fitted FROM fit GROUP BY 1"""))
def best_start(spark, sf):
    """The likelihood of the best of twenty starts, and how many of them could be fitted."""
    grid = _starts(spark, sf)
    best = regimes.best_runs(grid, "series_id").join(grid.groupBy("series_id").agg(F.count("log_likelihood").alias("fitted")), "series_id")
    return best.select("series_id", F.round("log_likelihood", 4).alias("log_likelihood"), "fitted")
