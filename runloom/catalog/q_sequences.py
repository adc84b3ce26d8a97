"""Queries: observation, sequences, runs and transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transitions as tr
from ..operators.ordered import Ordering
from ..operators.sequences import run_lengths
from .binding import (
    ANALYSIS_CTE, EPISODE_CTE, OBS_CTE, STATE_NAMES, analysis, athlete_order, episodes,
    observed_rows, table, with_cte,
)
from .registry import query


@query("o2_finish_matches", with_cte(OBS_CTE, "SELECT match_columns AS match_columns, count(*) AS n FROM obs GROUP BY 1"))
def finish_matches(spark, sf):
    rows = observed_rows(spark, sf)
    return rows.groupBy(F.array_join("finish_match_columns", ",").alias("match_columns")).agg(F.count(F.lit(1)).alias("n"))


@query("o5_class_of_row", with_cte(OBS_CTE, """
SELECT source_row_index, match_classes, hits > 1 AS ambiguous FROM obs"""))
def class_of_row(spark, sf):
    return observed_rows(spark, sf).select(
        "source_row_index", F.array_join("finish_match_classes", ",").alias("match_classes"),
        (F.size("finish_match_classes") > 1).alias("ambiguous"),
    )


@query("o6_observed_class", with_cte(OBS_CTE, """
SELECT source_row_index, observed_zap_class, observation_quality_flag, observation_resolution_type,
  observation_confidence_label, score_value, score_rounded, score_supported_class, 'observation_mapping_v2' AS mapping_version,
  match_columns || CASE WHEN match_columns = '' THEN '' ELSE ',' END || 'outcomes__score' AS source_columns
FROM obs"""))
def observed_class(spark, sf):
    return observed_rows(spark, sf).select(
        "source_row_index", "observed_zap_class", "observation_quality_flag", "observation_resolution_type",
        "observation_confidence_label", "score_value", "score_rounded", "score_supported_class", "mapping_version",
        F.array_join("observed_zap_source_columns", ",").alias("source_columns"),
    )


@query("o7_label_domains", with_cte(OBS_CTE, """
SELECT observed_zap_class, observation_resolution_type, observation_confidence_label, count(*) AS n FROM obs GROUP BY ALL"""))
def label_domains(spark, sf):
    return observed_rows(spark, sf).groupBy(
        "observed_zap_class", "observation_resolution_type", "observation_confidence_label"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("w1_sequence_assignment", with_cte(EPISODE_CTE, """
SELECT source_row_index, sequence_id, sequence_resolution_type, sequence_quality_flag, sequence_quality_reason FROM epi"""))
def sequence_assignment(spark, sf):
    return episodes(spark, sf).select(
        "source_row_index", "sequence_id", "sequence_resolution_type", "sequence_quality_flag", "sequence_quality_reason"
    )


_RUNS = EPISODE_CTE + """,
steps AS (
  SELECT *, lag(sequence_id) OVER (PARTITION BY sheet_name, athlete_name ORDER BY source_row_index) AS before FROM epi
),
runs AS (
  SELECT *, sum(CASE WHEN before <> sequence_id THEN 1 ELSE 0 END)
    OVER (PARTITION BY sheet_name, athlete_name ORDER BY source_row_index) AS run_no FROM steps
)"""


@query("w2_run_lengths", with_cte(_RUNS, """
SELECT sheet_name, athlete_name, CAST(run_no AS BIGINT) AS run_no, min(sequence_id) AS sequence_id, count(*) AS run_length
FROM runs GROUP BY 1, 2, 3"""))
def lengths(spark, sf):
    rows = episodes(spark, sf).select("sheet_name", "athlete_name", "source_row_index", "sequence_id")
    return run_lengths(rows, athlete_order(spark, sf))


_MOVES = ANALYSIS_CTE + """,
nx AS (
  SELECT hidden_state AS a, sequence_id, lead(hidden_state) OVER w AS b, lead(sequence_id) OVER w AS after FROM an
  WINDOW w AS (PARTITION BY sheet_name, athlete_name ORDER BY source_row_index)
),
mv AS (SELECT a AS from_state, b AS to_state, count(*) AS n FROM nx WHERE after = sequence_id GROUP BY 1, 2)"""


def _moves(spark, sf):
    rows = analysis(spark, sf).select("sheet_name", "athlete_name", "source_row_index", "sequence_id", "hidden_state")
    return tr.count_transitions(rows, athlete_order(spark, sf))


@query("w3_transition_summary", with_cte(_MOVES, """
SELECT from_state, to_state, 'S' || (from_state + 1) AS from_name, 'S' || (to_state + 1) AS to_name, n AS "count",
  round(n / sum(n) OVER (), 6) AS share, from_state = to_state AS is_self_loop FROM mv"""))
def transition_summary(spark, sf):
    return tr.named_transitions(_moves(spark, sf), STATE_NAMES).withColumn("share", F.round("share", 6))


@query("w4_direction_shares", with_cte(_MOVES, """
SELECT round(sum(CASE WHEN to_state > from_state THEN n ELSE 0 END) / sum(n), 6) AS forward_share,
  round(sum(CASE WHEN to_state < from_state THEN n ELSE 0 END) / sum(n), 6) AS backward_share,
  round(sum(CASE WHEN to_state = from_state THEN n ELSE 0 END) / sum(n), 6) AS self_share FROM mv"""))
def direction_shares(spark, sf):
    shares = tr.direction_shares(_moves(spark, sf))
    return shares.select([F.round(c, 6).alias(c) for c in shares.columns])


_ROLES = """
t AS (
  SELECT CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS s, conv_id,
    lead(CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END) OVER (PARTITION BY conv_id ORDER BY turn) AS s2
  FROM conversations
),
mv AS (SELECT s AS from_state, s2 AS to_state, count(*) AS n FROM t WHERE s2 IS NOT NULL GROUP BY 1, 2)"""


def _role_moves(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("conv_id").cast("string").alias("sequence_id"),
        F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2).alias("hidden_state"),
    )
    return tr.count_transitions(rows, Ordering(("conv_id",), "turn").inspect(rows))


@query("w3_role_transitions", with_cte(_ROLES, """
SELECT from_state, to_state, n AS "count", round(n / sum(n) OVER (), 6) AS share, from_state = to_state AS is_self_loop FROM mv"""))
def role_transitions(spark, sf):
    return _role_moves(spark, sf).withColumn("share", F.round("share", 6))


@query("w5_transition_differences", with_cte(_MOVES, """
, whole AS (
  SELECT hidden_state AS a, lead(hidden_state) OVER (PARTITION BY sheet_name, athlete_name ORDER BY source_row_index) AS b FROM an
), loose AS (SELECT a AS from_state, b AS to_state, count(*) AS n FROM whole WHERE b IS NOT NULL GROUP BY 1, 2)
SELECT from_state, to_state, n AS "count", 'stored_only' AS side FROM (SELECT * FROM loose EXCEPT ALL SELECT * FROM mv)
UNION ALL
SELECT from_state, to_state, n AS "count", 'recomputed_only' AS side FROM (SELECT * FROM mv EXCEPT ALL SELECT * FROM loose)"""))
def transition_differences(spark, sf):
    """A stored table that ignored run borders, against the recomputed one."""
    rows = analysis(spark, sf).select("sheet_name", "athlete_name", "source_row_index", "sequence_id", "hidden_state")
    order = athlete_order(spark, sf)
    stored = tr.count_transitions(rows.withColumn("sequence_id", F.lit("one")), order)
    return tr.transition_differences(stored, tr.count_transitions(rows, order))


@query("w6_top_transitions", with_cte(_MOVES, """
SELECT 'S' || (from_state + 1) || ' -> S' || (to_state + 1) AS transition, n AS "count" FROM mv ORDER BY n DESC, 1 LIMIT 12"""))
def top_transitions(spark, sf):
    return tr.top_transitions(tr.named_transitions(_moves(spark, sf), STATE_NAMES))
