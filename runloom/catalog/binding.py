"""Test tables seen as episode rows: once as DataFrames, once as SQL CTEs.

Each event is one episode row. Users are athletes, `user_id % 4` is the sheet,
the event type gives the score, and the number in `props` gives the indicators.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.episodes import FieldPlan, build_episodes, episode_fields
from ..operators.features import FeaturePlan, engineer
from ..operators.observation import observe
from ..operators.ordered import Ordering
from ..operators.transitions import state_name

ATHLETE = ("sheet_name", "athlete_name")
STATE_NAMES = {0: "S1", 1: "S2", 2: "S3"}
KFV_INDICATORS = (1, 7, 13, 19, 25)


def view(build):
    """Keep the lazy plan of a binding per session and folder, as a view would.

    Only the plan is kept, no data: every query still scans its tables.
    """
    plans: dict = {}

    @functools.wraps(build)
    def get(spark: SparkSession, sf: str) -> DataFrame:
        key = (id(spark), spark.sparkContext.applicationId, sf)
        if key not in plans:
            plans[key] = build(spark, sf)
        return plans[key]

    return get


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_POINTS = "CASE event_type WHEN 'view' THEN '0' WHEN 'signup' THEN '1' WHEN 'click' THEN '2' WHEN 'error' THEN '3' ELSE '4' END"
_RAW = {
    "metadata__sheet": "concat('s', user_id % 4)",
    "metadata__athlete_name": "CASE WHEN k = 99 THEN concat('Итого u', user_id) WHEN k = 98 THEN '' ELSE concat('u', user_id) END",
    "metadata__weight_class": "CASE WHEN user_id % 3 = 0 THEN '' ELSE string(60 + 10 * (user_id % 5)) END",
    "metadata__opponent_name": "CASE WHEN user_id % 2 = 0 THEN '' ELSE concat('o', user_id % 7) END",
    "metadata__event_date": "CASE WHEN user_id % 2 = 0 THEN '' ELSE date_format(ts, 'yyyy-MM-dd') END",
    "metadata__bout_id": "CASE WHEN user_id % 11 = 0 THEN concat('b', event_id div 50) ELSE '' END",
    "metadata__episode_id": "CASE WHEN k % 10 = 3 THEN 'ep_x' WHEN k % 10 = 4 THEN concat('A', mi) ELSE string(mi) END",
    "metadata__episode_duration": "value",
    "metadata__pause_duration": "CASE WHEN event_type = 'view' THEN value / 4 ELSE 0.0D END",
    "outcomes__score": "CASE WHEN k = 13 THEN '' WHEN k = 14 THEN 'n/a' WHEN k = 15 THEN concat(points, ',4') "
                       "WHEN k = 16 THEN concat(points, '.5') ELSE points END",
    "outcomes__finish_action_01": "CASE WHEN event_type = 'signup' AND k < 10 THEN 'да' ELSE 'нет' END",
    "outcomes__finish_action_04": "CASE WHEN value > 50 THEN '1' ELSE '0' END",
    "outcomes__finish_action_05": "CASE WHEN value > 80 THEN 'yes' ELSE '' END",
    "custom_finish_signal": "CASE WHEN k = 77 THEN '1' WHEN k = 78 THEN 'half' ELSE '' END",
    **{f"maneuvering__indicator_{i + 1:02d}": f"shiftright(act, {i}) & 1" for i in range(4)},
    **{f"kfv__indicator_{n:02d}": f"shiftright(act, {i + 2}) & 1" for i, n in enumerate(KFV_INDICATORS)},
    **{f"vup__indicator_{i + 1:02d}": f"shiftright(act, {i + 5}) & 1" for i in range(2)},
}
RAW_NAMES = list(_RAW)


@view
def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Tidy-named episode rows, one per event, as a projection of the scan."""
    return (
        table(spark, sf, "events")
        .selectExpr("*", "int(regexp_extract(props, '([0-9]+)', 1)) AS k", "hour(ts) * 60 + minute(ts) AS mi")
        .selectExpr("*", "CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN 0 ELSE k END AS act", f"{_POINTS} AS points")
        .selectExpr("event_id AS source_row_index", *[f"{text} AS {name}" for name, text in _RAW.items()])
    )


@view
def observed_rows(spark: SparkSession, sf: str) -> DataFrame:
    return observe(raw_rows(spark, sf), names=RAW_NAMES)


@view
def field_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical fields with observation and codes, before sequences are cut. No shuffle."""
    rows = engineer(observed_rows(spark, sf), FeaturePlan.from_names(RAW_NAMES))
    return episode_fields(rows, FieldPlan.from_names(RAW_NAMES))


@view
def episodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = engineer(observed_rows(spark, sf), FeaturePlan.from_names(RAW_NAMES))
    return build_episodes(rows, FieldPlan.from_names(RAW_NAMES))


def class_state(cls: Column) -> Column:
    return (
        F.when(cls.isin("zap_r", "no_score", "unknown"), 0).when(cls.isin("hold", "zap_n"), 1).otherwise(2).cast("int")
    )


def with_states(df: DataFrame) -> DataFrame:
    """Stand-in for a decoded model: the class gives the state, the row id the posteriors."""
    row = F.col("source_row_index")
    weights = [1 + row % 7, 1 + row % 5, 1 + row % 3]
    total = weights[0] + weights[1] + weights[2]
    out = df.withColumn("hidden_state", class_state(F.col("observed_zap_class")))
    out = out.withColumn("hidden_state_name", state_name(STATE_NAMES, F.col("hidden_state")))
    out = out.withColumns({f"p_state_{i}": w / total for i, w in enumerate(weights)})
    return out.withColumn("confidence", F.greatest("p_state_0", "p_state_1", "p_state_2")).withColumn(
        "observed_result", F.col("score")
    )


@view
def analysis(spark: SparkSession, sf: str) -> DataFrame:
    return with_states(episodes(spark, sf))


@view
def row_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Analysis rows for reports that need no sequence ids; stays free of shuffles."""
    return with_states(field_rows(spark, sf))


@view
def athlete_order(spark: SparkSession, sf: str) -> Ordering:
    """Order inside an athlete; crowded athletes are looked up once, on the raw rows."""
    rows = field_rows(spark, sf).select(*ATHLETE, "source_row_index")
    return Ordering(ATHLETE, "source_row_index").inspect(rows)


# --- the same binding for the SQL side -------------------------------------------

_BITS = ",\n    ".join(
    [f"(act >> {i}) & 1 AS maneuvering__indicator_{i + 1:02d}" for i in range(4)]
    + [f"(act >> {i + 2}) & 1 AS kfv__indicator_{n:02d}" for i, n in enumerate(KFV_INDICATORS)]
    + [f"(act >> {i + 5}) & 1 AS vup__indicator_{i + 1:02d}" for i in range(2)]
)

RAW_CTE = f"""
ev AS (
  SELECT *, hour(ts) * 60 + minute(ts) AS mi,
    CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN 0 ELSE k END AS act,
    CASE event_type WHEN 'view' THEN '0' WHEN 'signup' THEN '1' WHEN 'click' THEN '2' WHEN 'error' THEN '3' ELSE '4' END AS points
  FROM (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
),
raw AS (
  SELECT event_id AS source_row_index,
    's' || (user_id % 4) AS metadata__sheet,
    CASE WHEN k = 99 THEN 'Итого u' || user_id WHEN k = 98 THEN '' ELSE 'u' || user_id END AS metadata__athlete_name,
    CASE WHEN user_id % 3 = 0 THEN '' ELSE CAST(60 + 10 * (user_id % 5) AS VARCHAR) END AS metadata__weight_class,
    CASE WHEN user_id % 2 = 0 THEN '' ELSE 'o' || (user_id % 7) END AS metadata__opponent_name,
    CASE WHEN user_id % 2 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS metadata__event_date,
    CASE WHEN user_id % 11 = 0 THEN 'b' || (event_id // 50) ELSE '' END AS metadata__bout_id,
    CASE WHEN k % 10 = 3 THEN 'ep_x' WHEN k % 10 = 4 THEN 'A' || mi ELSE CAST(mi AS VARCHAR) END AS metadata__episode_id,
    value AS metadata__episode_duration,
    CASE WHEN event_type = 'view' THEN value / 4 ELSE 0.0 END AS metadata__pause_duration,
    CASE WHEN k = 13 THEN '' WHEN k = 14 THEN 'n/a' WHEN k = 15 THEN points || ',4' WHEN k = 16 THEN points || '.5'
         ELSE points END AS outcomes__score,
    CASE WHEN event_type = 'signup' AND k < 10 THEN 'да' ELSE 'нет' END AS outcomes__finish_action_01,
    CASE WHEN value > 50 THEN '1' ELSE '0' END AS outcomes__finish_action_04,
    CASE WHEN value > 80 THEN 'yes' ELSE '' END AS outcomes__finish_action_05,
    CASE WHEN k = 77 THEN '1' WHEN k = 78 THEN 'half' ELSE '' END AS custom_finish_signal,
    {_BITS}
  FROM ev
)"""

OBS_CTE = RAW_CTE + """,
sig AS (
  SELECT *, outcomes__finish_action_01 = 'да' AS f1, outcomes__finish_action_04 = '1' AS f4,
    outcomes__finish_action_05 = 'yes' AS f5,
    TRY_CAST(replace(outcomes__score, ',', '.') AS DOUBLE) AS score_value
  FROM raw
),
sc AS (
  SELECT *, CAST(f1 AS INTEGER) + CAST(f4 AS INTEGER) + CAST(f5 AS INTEGER) AS hits,
    CASE WHEN f1 THEN 'zap_r' WHEN f4 THEN 'hold' WHEN f5 THEN 'arm_submission' END AS direct,
    CAST(round_even(score_value, 0) AS INTEGER) AS score_rounded
  FROM sig
),
sm AS (
  SELECT *, CASE score_rounded WHEN 1 THEN 'zap_r' WHEN 2 THEN 'zap_n' WHEN 4 THEN 'zap_t' ELSE '' END AS score_supported_class
  FROM sc
),
obs AS (
  SELECT *,
    CASE WHEN hits > 1 THEN 'unknown' WHEN hits = 1 THEN direct WHEN score_value IS NULL THEN 'unknown'
         WHEN abs(score_value) < 1e-12 THEN 'no_score' WHEN score_supported_class = '' THEN 'unknown'
         ELSE score_supported_class END AS observed_zap_class,
    CASE WHEN hits > 1 THEN 'unknown_ambiguous_finish'
         WHEN hits = 1 AND score_supported_class IN ('', direct) THEN 'ok_finish_rule'
         WHEN hits = 1 THEN 'ok_finish_rule_score_mismatch'
         WHEN score_value IS NULL THEN 'unknown_missing_score_and_finish'
         WHEN abs(score_value) < 1e-12 THEN 'ok_no_score_rule'
         WHEN score_supported_class = '' THEN 'unknown_unsupported_score' ELSE 'ok_score_rule' END AS observation_quality_flag,
    CASE WHEN hits > 1 THEN 'ambiguous' WHEN hits = 1 THEN 'direct_finish_signal' WHEN score_value IS NULL THEN 'unknown'
         WHEN abs(score_value) < 1e-12 THEN 'no_score_rule' WHEN score_supported_class = '' THEN 'unknown'
         ELSE 'inferred_from_score' END AS observation_resolution_type,
    CASE WHEN hits > 1 THEN 'low' WHEN hits = 1 THEN 'high' WHEN score_value IS NULL THEN 'low'
         WHEN abs(score_value) < 1e-12 THEN 'high' WHEN score_supported_class = '' THEN 'low' ELSE 'medium' END AS observation_confidence_label,
    concat_ws(',', CASE WHEN f5 THEN 'arm_submission' END, CASE WHEN f4 THEN 'hold' END, CASE WHEN f1 THEN 'zap_r' END) AS match_classes,
    concat_ws(',', CASE WHEN f1 THEN 'outcomes__finish_action_01' END, CASE WHEN f4 THEN 'outcomes__finish_action_04' END,
              CASE WHEN f5 THEN 'outcomes__finish_action_05' END) AS match_columns
  FROM sm
)"""

FIELD_CTE = OBS_CTE + """,
fld AS (
  SELECT source_row_index, metadata__sheet AS sheet_name, metadata__athlete_name AS athlete_name,
    CASE WHEN metadata__athlete_name <> '' THEN metadata__athlete_name
         ELSE 'ath_' || substr(sha1(metadata__sheet || '::'), 1, 12) END AS athlete_id,
    metadata__weight_class AS weight_class, metadata__episode_id AS episode_id, metadata__opponent_name AS opponent_name,
    metadata__event_date AS tournament_name, metadata__event_date AS event_date,
    metadata__episode_duration AS episode_time_sec, metadata__pause_duration AS pause_time_sec,
    coalesce(TRY_CAST(outcomes__score AS DOUBLE), 0.0) AS score, metadata__bout_id AS explicit_id,
    log2(1.0 + maneuvering__indicator_01 + 2 * maneuvering__indicator_02) AS maneuver_right_code,
    log2(1.0 + maneuvering__indicator_03 + 2 * maneuvering__indicator_04) AS maneuver_left_code,
    log2(1.0 + kfv__indicator_01) AS kfv_capture_code, log2(1.0 + kfv__indicator_07) AS kfv_grip_code,
    log2(1.0 + kfv__indicator_13) AS kfv_wrap_code, log2(1.0 + kfv__indicator_19) AS kfv_hook_code,
    log2(1.0 + kfv__indicator_25) AS kfv_post_code,
    log2(1.0 + vup__indicator_01 + 2 * vup__indicator_02) AS vup_code,
    observed_zap_class, observation_quality_flag, observation_resolution_type, observation_confidence_label,
    match_classes, match_columns, score_value, score_rounded, score_supported_class
  FROM obs
)"""

EPISODE_CTE = FIELD_CTE + """,
keyed AS (
  SELECT *, explicit_id = '' AS surrogate,
    CASE WHEN explicit_id <> '' THEN sheet_name || '::explicit::' || explicit_id
         ELSE sheet_name || '::' || athlete_id || '::w=' || weight_class || '::opp=' || opponent_name || '::tour='
              || tournament_name || '::date=' || event_date END AS base_key,
    TRY_CAST(nullif(regexp_extract(episode_id, '([0-9]+)', 1), '') AS DOUBLE) AS ep,
    CAST(weight_class <> '' AS INTEGER) + CAST(opponent_name <> '' AS INTEGER) + CAST(tournament_name <> '' AS INTEGER)
      + CAST(event_date <> '' AS INTEGER) AS ctx
  FROM fld
),
lagged AS (
  SELECT *, coalesce(ep <= lag(ep) OVER (PARTITION BY base_key, surrogate ORDER BY source_row_index), false) AS brk,
    max(CASE WHEN ep IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY base_key, surrogate) = 1 AS numbered
  FROM keyed
),
blocked AS (
  SELECT *, sum(CAST(brk AS INTEGER)) OVER (PARTITION BY base_key, surrogate ORDER BY source_row_index) AS block_no FROM lagged
),
epi0 AS (
  SELECT *,
    CASE WHEN surrogate THEN base_key || '::block_' || printf('%02d', CAST(block_no AS INTEGER)) ELSE base_key END AS sequence_id,
    CASE WHEN surrogate THEN 'surrogate' ELSE 'explicit' END AS sequence_resolution_type,
    CASE WHEN NOT surrogate THEN 'high' WHEN ctx >= 2 AND numbered THEN 'high' WHEN ctx >= 1 OR numbered THEN 'medium'
         ELSE 'low' END AS sequence_quality_flag,
    CASE WHEN NOT surrogate THEN 'explicit_sequence_id' WHEN ctx >= 2 AND numbered THEN 'surrogate_context_and_episode_id'
         WHEN ctx = 0 AND numbered THEN 'surrogate_episode_only' WHEN ctx >= 1 THEN 'surrogate_partial_context'
         ELSE 'surrogate_no_context' END AS sequence_quality_reason,
    lower(athlete_name) LIKE '%итог%' AS is_total_row, source_row_index || '' AS row_text
  FROM blocked
),
epi AS (
  SELECT *, sheet_name || '::' || row_text AS source_record_id,
    (NOT is_total_row) AND episode_id <> 'ep_x' AND observed_zap_class <> 'unknown'
      AND sequence_quality_flag IN ('high', 'medium') AS is_train_eligible
  FROM epi0
)"""


def _states_of(source: str, name: str) -> str:
    return f""",
{name}_w AS (
  SELECT *, CASE WHEN observed_zap_class IN ('zap_r', 'no_score', 'unknown') THEN 0
                 WHEN observed_zap_class IN ('hold', 'zap_n') THEN 1 ELSE 2 END AS hidden_state,
    1 + source_row_index % 7 AS w0, 1 + source_row_index % 5 AS w1, 1 + source_row_index % 3 AS w2
  FROM {source}
),
{name} AS (
  SELECT *, 'S' || (hidden_state + 1) AS hidden_state_name, w0 / (w0 + w1 + w2) AS p_state_0, w1 / (w0 + w1 + w2) AS p_state_1,
    w2 / (w0 + w1 + w2) AS p_state_2, greatest(w0, w1, w2) / (w0 + w1 + w2) AS confidence, score AS observed_result
  FROM {name}_w
)"""


ROW_ANALYSIS_CTE = FIELD_CTE + _states_of("fld", "ra")
ANALYSIS_CTE = EPISODE_CTE + _states_of("epi", "an")


def with_cte(cte: str, select: str) -> str:
    return "WITH " + cte + "\n" + select
