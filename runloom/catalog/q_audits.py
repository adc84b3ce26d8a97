"""Queries: profiles, audits, health, recommendation and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import charts, frequency, health, metadata_audit, observation_audit, picks, profiles, sequence_audit
from ..operators.observation import ObservationRules
from .binding import (
    ANALYSIS_CTE, EPISODE_CTE, OBS_CTE, RAW_CTE, RAW_NAMES, ROW_ANALYSIS_CTE, STATE_NAMES, analysis,
    episodes, observed_rows, raw_rows, row_analysis, table, with_cte,
)
from .q_sequences import _MOVES, _moves
from .registry import query

ASSIGNED = {"S1": 0, "S2": 1, "S3": 2}
CONFIDENCE = {"S1": 0.6, "S2": 0.5, "S3": 0.45}


def rounded(df, *keep, digits=6):
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in df.columns if c not in keep])


_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in profiles.PROFILE_MEASURES)
_LINK = """CASE WHEN m >= k AND m >= v THEN 'maneuvering' WHEN k >= v THEN 'kfv' ELSE 'vup' END"""
_PROFILE = ROW_ANALYSIS_CTE + f""",
pr AS (
  SELECT hidden_state, {_MEANS}, count(*) AS episodes_count, min(hidden_state_name) AS hidden_state_name,
    avg(maneuver_right_code) + avg(maneuver_left_code) AS m,
    avg(kfv_capture_code) + avg(kfv_grip_code) + avg(kfv_wrap_code) + avg(kfv_hook_code) + avg(kfv_post_code) AS k, avg(vup_code) AS v
  FROM ra GROUP BY 1
)"""


@query("a1_state_profile", with_cte(_PROFILE, f"SELECT * EXCLUDE (m, k, v), {_LINK} AS key_link FROM pr"))
def state_profile(spark, sf):
    return rounded(profiles.state_profile(row_analysis(spark, sf)), "hidden_state", "episodes_count", "hidden_state_name", "key_link")


@query("a2_dominant_link", with_cte(_PROFILE, f"SELECT hidden_state, {_LINK} AS key_link FROM pr"))
def dominant_link(spark, sf):
    return profiles.state_profile(row_analysis(spark, sf)).select("hidden_state", "key_link")


@query("a3_feature_profile", with_cte(ROW_ANALYSIS_CTE, """
SELECT hidden_state, round(avg(maneuver_right_code), 6) AS maneuver_right_code, round(avg(vup_code), 6) AS vup_code,
  count(*) AS episodes_count, min(hidden_state_name) AS hidden_state_name FROM ra GROUP BY 1"""))
def feature_profile(spark, sf):
    out = profiles.feature_profile(row_analysis(spark, sf), ["maneuver_right_code", "vup_code"], STATE_NAMES)
    return rounded(out, "hidden_state", "episodes_count", "hidden_state_name")


def _research_profile(spark, sf):
    rows = row_analysis(spark, sf).withColumn("kfv_code", F.col("kfv_capture_code") + F.col("kfv_grip_code")).withColumn(
        "outcome_actions_code", F.col("score")
    )
    cols = ["maneuver_right_code", "maneuver_left_code", "kfv_code", "vup_code", "outcome_actions_code", "observed_result"]
    return profiles.feature_profile(rows, cols, STATE_NAMES)


@query("a4_state_interpretation", with_cte(ROW_ANALYSIS_CTE, """
, p AS (SELECT hidden_state, avg(maneuver_right_code) + avg(maneuver_left_code) AS m, avg(kfv_capture_code + kfv_grip_code) AS k,
  avg(vup_code) AS v, avg(score) AS o, count(*) AS episodes_count FROM ra GROUP BY 1)
SELECT hidden_state, episodes_count, CASE WHEN m >= k AND m >= v AND m >= o THEN 'maneuvering' WHEN k >= v AND k >= o THEN 'kfv'
  WHEN v >= o THEN 'vup' ELSE 'outcome_actions' END AS posthoc_block, 'S' || (hidden_state + 1) AS semantic_label,
  CASE hidden_state WHEN 0 THEN 0.6 WHEN 1 THEN 0.5 ELSE 0.45 END AS semantic_confidence FROM p"""))
def state_interpretation(spark, sf):
    out = profiles.interpret_states(_research_profile(spark, sf), ASSIGNED, CONFIDENCE)
    return out.select("hidden_state", "episodes_count", "posthoc_block", "semantic_label", "semantic_confidence")


@query("a5_state_lines", with_cte(ROW_ANALYSIS_CTE, """
SELECT hidden_state, printf('Latent state S%d: n=%d, maneuverR=%.2f, maneuverL=%.2f, KFV=%.2f, VUP=%.2f, result=%.2f', hidden_state + 1,
  count(*), avg(maneuver_right_code), avg(maneuver_left_code), avg(kfv_capture_code + kfv_grip_code), avg(vup_code), avg(score)) AS line
FROM ra GROUP BY 1"""))
def state_lines(spark, sf):
    return profiles.summary_lines(_research_profile(spark, sf))


_LAYER = ", ".join(
    f"round(avg(CASE WHEN observation_resolution_type = '{v}' THEN 1.0 ELSE 0.0 END), 6) AS {n}_share"
    for v, n in [("direct_finish_signal", "direct"), ("inferred_from_score", "inferred_from_score"),
                 ("no_score_rule", "no_score_rule"), ("ambiguous", "ambiguous"), ("unknown", "unknown")]
) + ", " + ", ".join(
    f"round(avg(CASE WHEN observation_confidence_label = '{v}' THEN 1.0 ELSE 0.0 END), 6) AS {v}_conf_share" for v in lx.CONFIDENCE_LABELS
)


@query("a6_observed_layer", with_cte(OBS_CTE, f"SELECT {_LAYER} FROM obs"))
def observed_layer(spark, sf):
    return rounded(profiles.observed_layer(observed_rows(spark, sf)))


_SEQ_SHARES = ", ".join(
    f"round(avg(CASE WHEN sequence_quality_flag = '{v}' THEN 1.0 ELSE 0.0 END), 6) AS {v}_quality_share" for v in ("high", "medium", "low")
) + ", " + ", ".join(
    f"round(avg(CASE WHEN sequence_resolution_type = '{v}' THEN 1.0 ELSE 0.0 END), 6) AS {v}_sequence_share"
    for v in ("explicit", "surrogate", "fallback")
)


@query("a7_sequence_quality", with_cte(EPISODE_CTE, f"SELECT {_SEQ_SHARES} FROM epi"))
def sequence_quality(spark, sf):
    return rounded(profiles.sequence_quality(episodes(spark, sf)))


_LEAD = """
SELECT hidden_state AS state, round(n / sum(n) OVER (), 6) AS share FROM (
  SELECT hidden_state, count(*) AS n, min(source_row_index) AS f FROM ra {where} GROUP BY 1) ORDER BY n DESC, f LIMIT 1"""


@query("a8_dominant_by_coverage", with_cte(ROW_ANALYSIS_CTE, _LEAD.format(where="")))
def dominant_by_coverage(spark, sf):
    return rounded(profiles.dominant_by_coverage(row_analysis(spark, sf)), "state")


@query("a9_dominant_confident", with_cte(ROW_ANALYSIS_CTE, _LEAD.format(where="WHERE confidence >= 0.70")))
def dominant_confident(spark, sf):
    return rounded(profiles.dominant_confident(row_analysis(spark, sf)), "state")


_POSTERIOR = """
SELECT i AS state, round(p, 6) AS share FROM (
  SELECT unnest([0, 1, 2]) AS i, unnest([avg(p_state_0), avg(p_state_1), avg(p_state_2)]) AS p FROM ra) ORDER BY p DESC, i LIMIT 1"""


@query("a10_dominant_by_posterior", with_cte(ROW_ANALYSIS_CTE, _POSTERIOR))
def dominant_by_posterior(spark, sf):
    return rounded(profiles.dominant_by_posterior(row_analysis(spark, sf)), "state")


_BRIDGE = """CASE WHEN observation_resolution_type = 'direct_finish_signal' THEN 'finish:' || replace(match_classes, ',', '+')
  WHEN observation_resolution_type = 'inferred_from_score' THEN 'score:' || score_rounded
  WHEN observation_resolution_type = 'no_score_rule' THEN 'score:0'
  ELSE observation_resolution_type || ':' || observation_quality_flag END"""


@query("a11_mapping_crosstab", with_cte(OBS_CTE, f"""
SELECT {_BRIDGE} AS bridge_source, observation_resolution_type, observed_zap_class, count(*) AS rows,
  round(count(*) / sum(count(*)) OVER (), 6) AS share FROM obs GROUP BY 1, 2, 3"""))
def mapping_crosstab(spark, sf):
    out = frequency.mapping_crosstab(observed_rows(spark, sf))
    return out.withColumn("share", F.round("share", 6))


@query("a12_finish_match_counts", with_cte(OBS_CTE, """
SELECT 'class' AS kind, observed_zap_class AS name, count(*) AS rows FROM obs WHERE hits = 1 GROUP BY 2
UNION ALL SELECT 'column', match_columns, count(*) FROM obs WHERE hits = 1 GROUP BY 2"""))
def finish_match_counts(spark, sf):
    return frequency.finish_match_counts(observed_rows(spark, sf))


_VALUES = """
v AS (
  SELECT 'l_returnflag' AS column_name, l_returnflag AS value FROM lineitem
  UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem
  UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR) FROM lineitem
),
c AS (SELECT column_name, value, count(*) AS rows FROM v GROUP BY 1, 2)"""
_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]


@query("a13_top_values", with_cte(_VALUES, """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY rows DESC, value) AS rank FROM c) WHERE rank <= 12"""))
def top_values(spark, sf):
    return frequency.top_values(frequency.value_counts(table(spark, sf, "lineitem"), _COLUMNS))


@query("a13_distinct_values", with_cte(_VALUES, "SELECT column_name, count(*) AS distinct_values FROM c GROUP BY 1"))
def distinct_values(spark, sf):
    return frequency.distinct_values(frequency.value_counts(table(spark, sf, "lineitem"), _COLUMNS))


_SHARE_COLUMNS = ["outcomes__finish_action_01", "outcomes__finish_action_04", "outcomes__finish_action_05", "custom_finish_signal"]


@query("a14_signal_shares", with_cte(RAW_CTE, " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) FILTER ({c} <> '') AS non_empty_rows, count(*) FILTER ({c} IN ('1', 'да', 'yes')) AS positive_rows,
  round(count(*) FILTER ({c} <> '') / count(*), 6) AS non_empty_share, round(count(*) FILTER ({c} IN ('1', 'да', 'yes')) / count(*), 6) AS positive_share
FROM raw""" for c in _SHARE_COLUMNS)))
def signal_shares(spark, sf):
    out = frequency.signal_shares(raw_rows(spark, sf), _SHARE_COLUMNS)
    return rounded(out, "column_name", "non_empty_rows", "positive_rows")


_SEQ = ANALYSIS_CTE + """,
modes AS (
  SELECT sequence_id, k, v, row_number() OVER (PARTITION BY sequence_id, k ORDER BY count(*) DESC, v) AS r FROM (
    SELECT sequence_id, 'r' AS k, sequence_resolution_type AS v FROM an UNION ALL SELECT sequence_id, 'q', sequence_quality_flag FROM an
    UNION ALL SELECT sequence_id, 'w', sequence_quality_reason FROM an) GROUP BY sequence_id, k, v
),
st AS (
  SELECT a.sequence_id, count(*) AS sequence_length,
    (SELECT max(v) FROM modes m WHERE m.sequence_id = a.sequence_id AND k = 'r' AND r = 1) AS resolution_type,
    (SELECT max(v) FROM modes m WHERE m.sequence_id = a.sequence_id AND k = 'q' AND r = 1) AS quality_flag,
    (SELECT max(v) FROM modes m WHERE m.sequence_id = a.sequence_id AND k = 'w' AND r = 1) AS quality_reason_mode,
    count(DISTINCT observed_zap_class) AS observed_unique_classes, count(DISTINCT hidden_state) AS hidden_unique_states,
    round(avg(CASE WHEN observed_zap_class = 'no_score' THEN 1.0 ELSE 0.0 END), 6) AS no_score_share,
    round(avg(CASE WHEN observed_zap_class = 'unknown' THEN 1.0 ELSE 0.0 END), 6) AS unknown_share
  FROM an a GROUP BY 1
),
ls AS (SELECT count(*) AS n_sequences, min(sequence_length) AS min, max(sequence_length) AS max, median(sequence_length) AS median,
  avg(sequence_length) AS mean, quantile_cont(sequence_length, 0.95) AS p95 FROM st),
su AS (
  SELECT st.*, greatest(25, ceil(p95)) AS lim,
    concat_ws(',', CASE WHEN observed_unique_classes <= 1 AND hidden_unique_states <= 1 THEN 'flat_observed_and_hidden' END,
      CASE WHEN quality_flag = 'low' THEN 'low_quality_segmentation' END,
      CASE WHEN no_score_share >= 0.95 AND observed_unique_classes <= 1 THEN 'mostly_no_score_flat_sequence' END,
      CASE WHEN sequence_length >= greatest(25, ceil(p95)) THEN 'suspiciously_long_sequence' END) AS reasons
  FROM st, ls
)"""


@query("a16_length_distribution", with_cte(_SEQ, """
SELECT sequence_length, count(*) AS sequence_count, round(count(*) / sum(count(*)) OVER (), 6) AS share_of_sequences FROM st GROUP BY 1"""))
def length_distribution(spark, sf):
    out = sequence_audit.length_distribution(sequence_audit.sequence_table(analysis(spark, sf)))
    return out.withColumn("share_of_sequences", F.round("share_of_sequences", 6))


@query("a17_sequence_table", with_cte(_SEQ, "SELECT * FROM st"))
def sequence_table(spark, sf):
    out = sequence_audit.sequence_table(analysis(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("no_score_share", "unknown_share")})


@query("a18_length_stats", with_cte(_SEQ, "SELECT n_sequences, min, max, round(median, 6) AS median, round(mean, 6) AS mean, round(p95, 6) AS p95 FROM ls"))
def length_stats(spark, sf):
    out = sequence_audit.length_stats(sequence_audit.sequence_table(analysis(spark, sf)))
    return rounded(out, "n_sequences", "min", "max")


@query("a19_reason_counts", with_cte(EPISODE_CTE, """
SELECT sequence_quality_reason AS reason, count(*) AS rows FROM epi GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def reason_counts(spark, sf):
    return frequency.reason_counts(episodes(spark, sf), "sequence_quality_reason")


_TOP = ROW_ANALYSIS_CTE + """,
ta AS (SELECT athlete_name FROM ra GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)"""


@query("a20_athlete_comparison", with_cte(_TOP, """
SELECT athlete_name, round(avg(observed_result), 6) AS mean_result, round(avg(CASE WHEN hidden_state = 0 THEN 1.0 ELSE 0.0 END), 6) AS share_state_0,
  round(avg(CASE WHEN hidden_state = 1 THEN 1.0 ELSE 0.0 END), 6) AS share_state_1,
  round(avg(CASE WHEN hidden_state = 2 THEN 1.0 ELSE 0.0 END), 6) AS share_state_2
FROM ra WHERE athlete_name IN (SELECT athlete_name FROM ta) GROUP BY 1"""))
def athlete_comparison(spark, sf):
    return rounded(charts.athlete_comparison(row_analysis(spark, sf), [0, 1, 2]), "athlete_name")


@query("j3_top_athlete_rows", with_cte(_TOP, """
SELECT athlete_name, count(*) AS rows FROM ra WHERE athlete_name IN (SELECT athlete_name FROM ta) GROUP BY 1"""))
def top_athlete_rows(spark, sf):
    return charts.keep_top_athletes(row_analysis(spark, sf)).groupBy("athlete_name").agg(F.count(F.lit(1)).alias("rows"))


@query("a21_success_counts", with_cte(ROW_ANALYSIS_CTE, """
SELECT hidden_state_name, count(*) FILTER (observed_result > 0) AS successful, count(*) FILTER (observed_result <= 0) AS unsuccessful
FROM ra GROUP BY 1"""))
def success_counts(spark, sf):
    return charts.success_counts(row_analysis(spark, sf))


@query("t1_suspicious_sequences", with_cte(_SEQ, """
SELECT sequence_id, sequence_length, reasons AS suspicion_reasons FROM su WHERE reasons <> ''"""))
def suspicious_sequences(spark, sf):
    found = sequence_audit.suspicious(sequence_audit.sequence_table(analysis(spark, sf)))
    return sequence_audit.by_length(found).select("sequence_id", "sequence_length", F.array_join("suspicion_reasons", ",").alias("suspicion_reasons"))


@query("d5_sequence_audit", with_cte(_SEQ, f"""
, sh AS (SELECT {_SEQ_SHARES} FROM epi)
SELECT n_sequences, CAST(lim AS BIGINT) AS long_sequence_threshold, ns AS suspicious_sequences, nl AS suspicious_long_sequences,
  nf AS suspicious_flat_sequences, sh.explicit_sequence_share, sh.surrogate_sequence_share, sh.low_quality_share,
  concat_ws(',', CASE WHEN sh.explicit_sequence_share <= 0 THEN 'no_explicit_ids' END,
    CASE WHEN sh.surrogate_sequence_share >= 0.8 THEN 'mostly_surrogate' END, CASE WHEN sh.low_quality_share >= 0.3 THEN 'much_low_quality' END,
    CASE WHEN ns > 0 THEN 'suspicious_sequences_found' END, 'context_fields_missing') AS warnings
FROM ls, sh, (SELECT max(lim) AS lim, count(*) FILTER (reasons <> '') AS ns, count(*) FILTER (reasons LIKE '%suspiciously_long%') AS nl,
  count(*) FILTER (reasons LIKE '%flat_observed%') AS nf FROM su)"""))
def sequence_report(spark, sf):
    out = sequence_audit.audit(analysis(spark, sf))["summary"]
    return out.select(
        "n_sequences", "long_sequence_threshold", "suspicious_sequences", "suspicious_long_sequences", "suspicious_flat_sequences",
        *[F.round(c, 6).alias(c) for c in ("explicit_sequence_share", "surrogate_sequence_share", "low_quality_share")],
        F.array_join("warnings", ",").alias("warnings"),
    )


_FIELDS = ["athlete_name", "sheet_name", "weight_class", "opponent_name", "event_date", "episode_id"]
_NUMBERS = ["episode_time_sec", "pause_time_sec", "score"]
_QUALITY = ROW_ANALYSIS_CTE + ",\nfq AS (" + " UNION ALL ".join(
    [f"SELECT '{f}' AS field, count(*) FILTER ({f} = '') / count(*) AS missing_share, NULL AS zero_share, "
     f"count(DISTINCT nullif({f}, '')) AS unique_values FROM ra" for f in _FIELDS]
    + [f"SELECT '{f}', count(*) FILTER ({f} IS NULL) / count(*), count(*) FILTER (coalesce({f}, 0) = 0) / count(*), "
       f"count(DISTINCT {f}) FROM ra" for f in _NUMBERS]
) + """)"""


@query("d3_field_quality", with_cte(_QUALITY, """
SELECT field, round(missing_share, 6) AS missing_share, round(zero_share, 6) AS zero_share, unique_values,
  1 - coalesce(zero_share, missing_share) >= 0.10 AND unique_values >= 2 AS informative FROM fq"""))
def field_quality(spark, sf):
    out = metadata_audit.field_quality(row_analysis(spark, sf), _FIELDS + _NUMBERS)
    return out.select("field", F.round("missing_share", 6).alias("missing_share"), F.round("zero_share", 6).alias("zero_share"),
                      "unique_values", "informative")


@query("d3_order_field_quality", """
WITH fq AS (
  SELECT 'o_orderstatus' AS field, count(*) FILTER (o_orderstatus = '') / count(*) AS missing_share, NULL AS zero_share,
    count(DISTINCT o_orderstatus) AS unique_values FROM orders
  UNION ALL SELECT 'o_orderpriority', count(*) FILTER (o_orderpriority = '') / count(*), NULL, count(DISTINCT o_orderpriority) FROM orders
  UNION ALL SELECT 'o_custkey', 0.0, count(*) FILTER (o_custkey = 0) / count(*), count(DISTINCT o_custkey) FROM orders)
SELECT field, round(missing_share, 6) AS missing_share, round(zero_share, 6) AS zero_share, unique_values,
  1 - coalesce(zero_share, missing_share) >= 0.10 AND unique_values >= 2 AS informative FROM fq""")
def order_field_quality(spark, sf):
    out = metadata_audit.field_quality(
        table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"], ["o_custkey"], row="o_orderkey"
    )
    return out.select("field", F.round("missing_share", 6).alias("missing_share"), F.round("zero_share", 6).alias("zero_share"),
                      "unique_values", "informative")


@query("t5_sample_values", with_cte(ROW_ANALYSIS_CTE, """
, s AS (""" + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, min(source_row_index) AS f FROM ra WHERE {f} <> '' GROUP BY 2" for f in _FIELDS) + """),
k AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY f, value) AS r FROM s)
SELECT field, string_agg(value, '|' ORDER BY r) AS samples FROM k WHERE r <= 5 GROUP BY 1"""))
def sample_values(spark, sf):
    values = metadata_audit.field_values(row_analysis(spark, sf), _FIELDS)
    return metadata_audit.sample_values(values).select("field", F.array_join("sample_values", "|").alias("samples"))


@query("d4_metadata_audit", with_cte(ANALYSIS_CTE, """
SELECT count(*) AS rows_total, 'strong' AS segmentation_readiness,
  CASE WHEN count(*) FILTER (pause_time_sec <> 0) / count(*) >= 0.1 THEN 'strong' ELSE 'partial' END AS temporal_readiness,
  'strong' AS semantic_readiness, '' AS warnings FROM an"""))
def metadata_report(spark, sf):
    out = metadata_audit.audit(analysis(spark, sf))["summary"]
    return out.select("rows_total", "segmentation_readiness", "temporal_readiness", "semantic_readiness",
                      F.array_join("warnings", ",").alias("warnings"))


@query("d2_finish_signals", with_cte(RAW_CTE, " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) FILTER ({c} <> '') AS non_empty_rows, count(*) FILTER ({c} IN ('1', 'да', 'yes')) AS positive_rows,
  count(DISTINCT nullif({c}, '')) AS distinct_non_empty_values, '{'unsupported' if c.startswith('custom') else 'mapped'}' AS mapping_status
FROM raw""" for c in _SHARE_COLUMNS)))
def finish_signals(spark, sf):
    out = observation_audit.finish_signals(raw_rows(spark, sf), ObservationRules(), RAW_NAMES)
    return out.select("column_name", "non_empty_rows", "positive_rows", "distinct_non_empty_values", "mapping_status")


@query("d2_unsupported_values", with_cte(RAW_CTE, """
, n AS (SELECT count(*) AS n FROM raw)
SELECT 'custom_finish_signal' AS column_name, custom_finish_signal AS raw_value, count(*) AS rows,
  round(count(*) / sum(count(*)) OVER (), 6) AS share_within_column, round(count(*) / max(n), 6) AS share_of_total_rows
FROM raw, n WHERE custom_finish_signal <> '' GROUP BY 2"""))
def unsupported_values(spark, sf):
    rows = raw_rows(spark, sf)
    out = observation_audit.unsupported_values(rows, observation_audit.finish_signals(rows, ObservationRules(), RAW_NAMES))
    return rounded(out.select("column_name", "raw_value", "rows", "share_within_column", "share_of_total_rows"), "column_name", "raw_value", "rows")


@query("d2_score_values", with_cte(RAW_CTE, """
, s AS (SELECT CAST(round_even(TRY_CAST(outcomes__score AS DOUBLE), 0) AS INTEGER) AS score_rounded FROM raw)
SELECT score_rounded, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share, score_rounded IN (0, 1, 2, 4) AS supported
FROM s WHERE score_rounded IS NOT NULL GROUP BY 1"""))
def score_values(spark, sf):
    out = observation_audit.score_values(raw_rows(spark, sf), ObservationRules(), "outcomes__score")
    return out.withColumn("share", F.round("share", 6))


@query("d2_observation_audit", with_cte(OBS_CTE, """
SELECT count(*) AS rows_total, count(*) FILTER (hits > 0) AS mapped_finish_positive_rows,
  count(*) FILTER (custom_finish_signal = '1') AS unmapped_finish_positive_rows, count(*) FILTER (f4) AS hold_positive_rows,
  count(*) FILTER (f5) AS arm_submission_positive_rows, 0 AS leg_submission_positive_rows, 'custom_finish_signal' AS unsupported_finish_columns,
  '3' AS unsupported_scores, 'unmapped_positive_columns,mapping_gap,unsupported_finish_values,unsupported_scores' AS warnings
FROM obs"""))
def observation_report(spark, sf):
    out = observation_audit.audit(observed_rows(spark, sf), names=RAW_NAMES)["summary"]
    return out.select(
        "rows_total", "mapped_finish_positive_rows", "unmapped_finish_positive_rows", "hold_positive_rows",
        "arm_submission_positive_rows", "leg_submission_positive_rows",
        F.array_join("unsupported_finish_columns", ",").alias("unsupported_finish_columns"),
        F.array_join(F.col("unsupported_scores").cast("array<string>"), ",").alias("unsupported_scores"),
        F.array_join("warnings", ",").alias("warnings"),
    )


_HEALTH = _MOVES + f""",
us AS (SELECT hidden_state, count(*) AS n FROM an GROUP BY 1),
hl AS (
  SELECT (SELECT sum(n) FROM us) AS rows_total, (SELECT count(*) FILTER (n >= 0.05 * (SELECT sum(n) FROM us)) / 3 FROM us) AS effective_state_usage,
    (SELECT sum(n) FILTER (from_state = to_state) / sum(n) FROM mv) AS self_transition_share,
    (SELECT max(n) FILTER (from_state = to_state) / (SELECT sum(n) FROM mv) FROM mv) AS top_self_transition_share
)"""


def _health(spark, sf):
    rows = analysis(spark, sf)
    return health.model_health(rows, _moves(spark, sf), profiles.state_profile(rows), profiles.observed_layer(rows), 3, ASSIGNED, CONFIDENCE)


@query("d7_model_health", with_cte(_HEALTH, """
SELECT CAST(rows_total AS BIGINT) AS rows_total, round(effective_state_usage, 6) AS effective_state_usage,
  round(self_transition_share, 6) AS self_transition_share, round(top_self_transition_share, 6) AS top_self_transition_share,
  'full' AS semantic_quality, self_transition_share >= 0.95 OR effective_state_usage <= 0.34 AS degenerate_transition_warning FROM hl"""))
def model_health(spark, sf):
    out = _health(spark, sf)
    return out.select(
        "rows_total", *[F.round(c, 6).alias(c) for c in ("effective_state_usage", "self_transition_share", "top_self_transition_share")],
        "semantic_quality", "degenerate_transition_warning",
    )


@query("d8_recommendation", with_cte(ANALYSIS_CTE + f""",
ra AS (SELECT * FROM an),
cov AS ({_LEAD.format(where="")}), mp AS ({_POSTERIOR}),
ob AS (SELECT {_LAYER} FROM epi), sq AS (SELECT {_SEQ_SHARES} FROM epi)""", """
SELECT CASE WHEN direct_share < 0.05 OR no_score_rule_share > 0.7 OR ambiguous_share + unknown_share > 0.2 OR surrogate_sequence_share > 0.8
    THEN 'cautious profile' ELSE 'other' END AS profile, round(cov.share, 6) AS coverage_share, round(mp.share, 6) AS posterior_share
FROM cov, mp, ob, sq"""))
def recommendation(spark, sf):
    rows = analysis(spark, sf)
    out = health.recommend(health.votes(rows, ASSIGNED), _health(spark, sf), profiles.observed_layer(rows), profiles.sequence_quality(rows))
    return out.select("profile", F.round("coverage_share", 6).alias("coverage_share"), F.round("posterior_share", 6).alias("posterior_share"))


@query("d9_report_flags", with_cte(ANALYSIS_CTE + f""",
pr AS (
  SELECT hidden_state, avg(maneuver_right_code) + avg(maneuver_left_code) AS m, avg(vup_code) AS v,
    avg(kfv_capture_code + kfv_grip_code + kfv_wrap_code + kfv_hook_code + kfv_post_code) AS k FROM an GROUP BY 1
),
ob AS (SELECT {_LAYER} FROM epi), sq AS (SELECT {_SEQ_SHARES} FROM epi)""", f"""
SELECT 'finding' AS section, 'mostly_no_score' AS code FROM ob WHERE no_score_rule_share >= 0.7
UNION ALL SELECT 'finding', unnest(['unsupported_scores', 'unmapped_finish_columns', 'mapping_gap'])
UNION ALL SELECT 'finding', 'surrogate_segmentation' FROM sq WHERE explicit_sequence_share <= 0.01 AND surrogate_sequence_share >= 0.9
UNION ALL SELECT 'finding', 'maneuvering_only_states' FROM pr HAVING bool_and({_LINK} = 'maneuvering')
UNION ALL SELECT 'next_action', unnest(['extend_mapping_rules', 'add_score_rules'])
UNION ALL SELECT 'next_action', 'add_sequence_marker' FROM sq WHERE explicit_sequence_share <= 0.01"""))
def report_flags(spark, sf):
    rows = analysis(spark, sf)
    observation = observation_audit.audit(observed_rows(spark, sf), names=RAW_NAMES)["summary"]
    metadata = metadata_audit.audit(rows)["summary"]
    return health.report_flags(
        observation, profiles.observed_layer(rows), profiles.sequence_quality(rows), _health(spark, sf), metadata
    ).select("section", "code")


@query("d11_run_summary", with_cte(ANALYSIS_CTE, """
SELECT count(*) AS rows_total, count(*) FILTER (is_train_eligible) AS rows_train_eligible, count(DISTINCT sequence_id) AS n_sequences,
  'observation_mapping_v2' AS mapping_version, round(avg(CASE WHEN sequence_resolution_type = 'explicit' THEN 1.0 ELSE 0.0 END), 6) AS explicit_sequence_share
FROM an"""))
def run_summary(spark, sf):
    rows = analysis(spark, sf)
    out = health.run_summary(rows, profiles.observed_layer(rows), profiles.sequence_quality(rows))
    return out.select("rows_total", "rows_train_eligible", "n_sequences", "mapping_version",
                      F.round("explicit_sequence_share", 6).alias("explicit_sequence_share"))


_SIGNAL = "(maneuver_right_code + maneuver_left_code + vup_code + abs(observed_result)) > 0"


@query("t2_sample_row", with_cte(ANALYSIS_CTE, f"""
SELECT source_row_index, episode_id, hidden_state FROM an ORDER BY CASE WHEN episode_id <> '' AND {_SIGNAL} THEN 0 ELSE 1 END, source_row_index LIMIT 1"""))
def sample_row(spark, sf):
    return picks.sample_row(analysis(spark, sf)).select("source_row_index", "episode_id", "hidden_state")


@query("t3_insight_by_index", with_cte(ROW_ANALYSIS_CTE, """
SELECT source_row_index, episode_id, 'explicit_index' AS selection_reason FROM ra ORDER BY source_row_index LIMIT 1 OFFSET 137"""))
def insight_by_index(spark, sf):
    return picks.insight_row(row_analysis(spark, sf), 137).select("source_row_index", "episode_id", "selection_reason")


@query("t4_episode_insight", with_cte(ROW_ANALYSIS_CTE, """
SELECT source_row_index, episode_id, hidden_state, 'most_likely_state' AS message, 'auto_first_informative' AS selection_reason
FROM ra WHERE observed_result > 0 OR maneuver_right_code + maneuver_left_code + vup_code > 0 ORDER BY source_row_index LIMIT 1"""))
def episode_insight(spark, sf):
    return picks.insight(row_analysis(spark, sf)).select("source_row_index", "episode_id", "hidden_state", "message", "selection_reason")


@query("v1_state_points", with_cte(ROW_ANALYSIS_CTE, "SELECT source_row_index, hidden_state, hidden_state_name FROM ra"))
def state_points(spark, sf):
    return charts.state_points(row_analysis(spark, sf))


@query("v2_posterior_points", with_cte(ROW_ANALYSIS_CTE, " UNION ALL ".join(
    f"SELECT source_row_index, {i} AS state, 'S{i + 1}' AS label, round(p_state_{i}, 6) AS probability FROM ra" for i in range(3))))
def posterior_points(spark, sf):
    out = charts.posterior_points(row_analysis(spark, sf), STATE_NAMES)
    return out.withColumn("probability", F.round("probability", 6))
