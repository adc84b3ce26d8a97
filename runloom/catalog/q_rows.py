"""Queries: coercions, tidy columns, cleaning, features and the canonical table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce, lexicon as lx
from ..operators import cleaning, episodes as ep, features, tidy
from ..operators.transitions import state_name, transition_differences, unexpected_names
from .binding import (
    EPISODE_CTE, FIELD_CTE, RAW_CTE, ROW_ANALYSIS_CTE, episodes, field_rows, raw_rows, row_analysis, table, with_cte,
)
from .registry import query

# --- coercions ------------------------------------------------------------------------

# number-like texts made from the events, every kind of odd spelling included
_ODD = """CASE k % 12 WHEN 0 THEN ' ' || k || ' ' WHEN 1 THEN k || 'e1' WHEN 2 THEN '1_' || k WHEN 3 THEN 'inf' WHEN 4 THEN k || 'd'
  WHEN 5 THEN k || 'f' WHEN 6 THEN 'nan' WHEN 7 THEN k || ',5' WHEN 8 THEN '0x' || k WHEN 9 THEN '.' || k WHEN 10 THEN k || '.' ELSE '+' || k END"""
_WORD = """CASE k % 13 WHEN 0 THEN 'Да' WHEN 1 THEN ' yes ' WHEN 2 THEN 'ИСТИНА' WHEN 3 THEN 'y' WHEN 4 THEN 'нет' WHEN 5 THEN 'ложь' WHEN 6 THEN 'n'
  WHEN 7 THEN '0' WHEN 8 THEN '0.5' WHEN 9 THEN '-1' WHEN 10 THEN 'None' WHEN 11 THEN '' ELSE 'true' END"""
_TEXTS = f"""
t AS (SELECT event_id, user_id, k, {_ODD} AS odd, {_WORD} AS word FROM
  (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""


def _texts(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", "user_id", "int(regexp_extract(props, '([0-9]+)', 1)) AS k")
    return rows.selectExpr("*", f"{_ODD} AS odd", f"{_WORD} AS word")


_NUMBER = """CASE k % 12 WHEN 0 THEN k WHEN 1 THEN k * 10.0 WHEN 9 THEN CAST('.' || k AS DOUBLE) WHEN 10 THEN k WHEN 11 THEN k END"""


@query("n1_number", with_cte(_TEXTS, f"""
SELECT event_id, CASE WHEN k % 12 = 3 THEN -1.0 ELSE {_NUMBER} END AS number, coalesce(CASE WHEN k % 12 = 3 THEN -1.0 ELSE {_NUMBER} END, 0.0) AS or_zero FROM t"""))
def number(spark, sf):
    value = coerce.number(F.col("odd"))
    finite = F.when(value == float("inf"), F.lit(-1.0)).otherwise(value)
    return _texts(spark, sf).select("event_id", finite.alias("number"), F.coalesce(finite, F.lit(0.0)).alias("or_zero"))


@query("n2_safe_text", with_cte(_TEXTS, """
SELECT event_id, CASE WHEN k % 12 = 6 THEN '' ELSE trim(odd) END AS text, CASE WHEN trim(word) IN ('', 'None') THEN '' ELSE trim(word) END AS word_text FROM t"""))
def safe_text(spark, sf):
    return _texts(spark, sf).select(
        "event_id", coerce.safe_text(F.col("odd")).alias("text"), coerce.safe_text(F.col("word")).alias("word_text")
    )


@query("n3_score", with_cte(_TEXTS, f"""
SELECT event_id, CASE WHEN k % 12 = 3 THEN -1.0 WHEN k % 12 = 7 THEN k + 0.5 ELSE {_NUMBER} END AS score FROM t"""))
def score(spark, sf):
    value = coerce.score(F.col("odd"))
    return _texts(spark, sf).select("event_id", F.when(value == float("inf"), F.lit(-1.0)).otherwise(value).alias("score"))


@query("n4_cell_number", with_cte(_TEXTS, f"""
SELECT event_id, coalesce(CASE WHEN k % 12 = 3 THEN -1.0 WHEN k % 12 = 7 THEN k + 0.5 ELSE {_NUMBER} END, 0.0) AS value FROM t"""))
def cell_number(spark, sf):
    value = coerce.cell_number(F.col("odd"))
    return _texts(spark, sf).select("event_id", F.when(value == float("inf"), F.lit(-1.0)).otherwise(value).alias("value"))


@query("n5_is_positive", with_cte(_TEXTS, "SELECT event_id, k % 13 IN (0, 1, 2, 3, 8, 12) AS positive FROM t"))
def is_positive(spark, sf):
    return _texts(spark, sf).select("event_id", coerce.is_positive(F.col("word")).alias("positive"))


@query("n6_cell_flag", with_cte(_TEXTS, "SELECT event_id, CAST(k % 13 IN (0, 1, 2, 8, 9, 12) AS INTEGER) AS flag FROM t"))
def cell_flag(spark, sf):
    """`-1` reads as 1 here: the label form drops the sign."""
    return _texts(spark, sf).select("event_id", coerce.cell_flag(F.col("word")).alias("flag"))


@query("n7_indicator_flag", with_cte(_TEXTS, "SELECT event_id, CAST(k % 13 IN (0, 1, 8, 12) AS INTEGER) AS flag FROM t"))
def indicator_flag(spark, sf):
    return _texts(spark, sf).select("event_id", coerce.indicator_flag(F.col("word")).alias("flag"))


@query("n8_is_filled", with_cte(_TEXTS, "SELECT event_id, k % 13 NOT IN (10, 11) AS filled, k % 12 <> 6 AS odd_filled FROM t"))
def is_filled(spark, sf):
    return _texts(spark, sf).select(
        "event_id", coerce.is_filled(F.col("word")).alias("filled"), coerce.is_filled(F.col("odd")).alias("odd_filled")
    )


@query("n9_is_episode_id", with_cte(_TEXTS, "SELECT event_id, k % 12 IN (0, 1, 3, 4, 5, 9, 10, 11) AS id_like FROM t"))
def is_episode_id(spark, sf):
    return _texts(spark, sf).select("event_id", coerce.is_episode_id(F.col("odd")).alias("id_like"))


@query("n10_episode_number", with_cte(_TEXTS, f"""
SELECT event_id, CASE WHEN k % 12 = 3 THEN -1.0 WHEN k % 12 IN (4, 5, 7) THEN k WHEN k % 12 = 2 THEN 1 WHEN k % 12 = 8 THEN 0
  ELSE {_NUMBER} END AS episode_number FROM t"""))
def episode_number(spark, sf):
    value = coerce.episode_number(F.col("odd"))
    return _texts(spark, sf).select(
        "event_id", F.when(value == float("inf"), F.lit(-1.0)).otherwise(value).alias("episode_number")
    )


@query("n11_surrogate_athlete_id", """
SELECT DISTINCT user_id, 'ath_' || substr(sha1('s' || (user_id % 4) || '::u' || user_id), 1, 12) AS athlete_id FROM events""")
def surrogate_athlete_id(spark, sf):
    users = table(spark, sf, "events").select("user_id").distinct()
    athlete = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    sheet = F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string"))
    return users.select("user_id", coerce.surrogate_athlete_id(athlete, sheet).alias("athlete_id"))


@query("n14_parsed_list", with_cte(_TEXTS, """
SELECT event_id, CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN 2 ELSE 0 END AS items, CASE WHEN k % 3 = 1 THEN 'a' || k END AS first_item FROM t"""))
def parsed_list(spark, sf):
    text = F.expr("""CASE k % 3 WHEN 0 THEN 'not a list' WHEN 1 THEN concat('["a', k, '", "b"]') ELSE '' END""")
    items = coerce.parse_list(text)
    return _texts(spark, sf).select("event_id", F.size(items).alias("items"), F.try_element_at(items, F.lit(1)).alias("first_item"))


@query("n15_list_text", with_cte(_TEXTS, """
SELECT event_id, '["a","b' || (k % 3) || '","c"]' AS text FROM t"""))
def list_text(spark, sf):
    items = F.array(F.lit("c"), F.concat(F.lit("b"), (F.col("k") % 3).cast("string")), F.lit("a"), F.lit("c"))
    return _texts(spark, sf).select("event_id", coerce.list_text(items).alias("text"))


@query("n16_is_text_present", with_cte(_TEXTS, "SELECT event_id, k % 13 NOT IN (10, 11) AS present FROM t"))
def is_text_present(spark, sf):
    return _texts(spark, sf).select("event_id", coerce.is_text_present(F.col("word")).alias("present"))


@query("n17_sequence_default", with_cte(_TEXTS, """
SELECT event_id, CASE WHEN trim(word) IN ('', 'None') THEN 'sequence_0' ELSE trim(word) END AS sequence_id FROM t"""))
def sequence_default(spark, sf):
    return _texts(spark, sf).select("event_id", coerce.sequence_or_default(F.col("word")).alias("sequence_id"))


# --- tidy columns ------------------------------------------------------------------------

_SOURCE_HEADERS = {
    "metadata__sheet": "_sheet", "metadata__athlete_name": "ФИО борца", "metadata__episode_id": "технико-тактический  эпизод",
    "metadata__episode_duration": "Технико-тактический эпизод_2", "outcomes__score": "Баллы",
    "maneuvering__indicator_01": "стойка и маневрирование самбиста (основные в эпизоде)",
    "kfv__indicator_01": "Захват за пояс", "outcomes__finish_action_01": "Удержание", "custom_finish_signal": "Заметка",
}


def _raw_sheet(spark, sf):
    rows = raw_rows(spark, sf).select("source_row_index", *[F.col(c).alias(h) for c, h in _SOURCE_HEADERS.items()])
    return rows.withColumn("Пусто", F.lit(None).cast("string"))


_P7 = """SELECT source_row_index, metadata__sheet, metadata__athlete_name AS metadata__athlete_name_02,
  metadata__episode_id AS metadata__episode_attr_01_03, coalesce(TRY_CAST(outcomes__score AS DOUBLE), 0.0) AS outcomes__score,
  CAST(maneuvering__indicator_01 AS DOUBLE) AS maneuvering__indicator_01, CAST(kfv__indicator_01 AS DOUBLE) AS kfv__f01,
  0.0 AS outcomes__f02, custom_finish_signal AS other__f01, '' AS other__f02 FROM raw"""


@query("p7_tidy_rows", with_cte(RAW_CTE, _P7))
def tidy_rows(spark, sf):
    return tidy.tidy(_raw_sheet(spark, sf)).rows.drop("metadata__episode_attr_02_04")


@query("p8_typed_blocks", with_cte(RAW_CTE, """
SELECT round(sum(coalesce(TRY_CAST(outcomes__score AS DOUBLE), 0.0)), 4) AS score_sum, count(*) FILTER (custom_finish_signal = '') AS blanks,
  count(*) AS rows FROM raw"""))
def typed_blocks(spark, sf):
    rows = tidy.tidy(_raw_sheet(spark, sf)).rows
    return rows.agg(
        F.round(F.sum("outcomes__score"), 4).alias("score_sum"), F.count(F.when(F.col("other__f01") == "", 1)).alias("blanks"),
        F.count(F.lit(1)).alias("rows"),
    )


@query("p9_structure", """
SELECT 'kfv,maneuvering,metadata,other,outcomes' AS present_blocks, 'vup' AS missing_blocks, count(*) AS row_count, 11 AS column_count,
  false AS is_valid FROM events""")
def structure(spark, sf):
    result = tidy.tidy(_raw_sheet(spark, sf))
    out = tidy.validate(result.mapping_table(spark), result.rows)
    return out.withColumns({c: F.array_join(c, ",") for c in ("present_blocks", "missing_blocks")})


@query("p11_null_columns", "SELECT 'Пусто' AS dropped, count(*) AS rows FROM events")
def null_columns(spark, sf):
    rows = _raw_sheet(spark, sf)
    kept = cleaning.drop_null_columns(rows)
    lost = [c for c in rows.columns if c not in kept.columns]
    return kept.agg(F.lit(",".join(lost)).alias("dropped"), F.count(F.lit(1)).alias("rows"))


@query("p12_stripped_text", "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents")
def stripped_text(spark, sf):
    return cleaning.strip_text(table(spark, sf, "documents").select("doc_id", "text"))


# --- cleaning -------------------------------------------------------------------------------

_FILLED = RAW_CTE + """,
fill AS (SELECT * REPLACE (last_value(nullif(metadata__athlete_name, '') IGNORE NULLS)
    OVER (PARTITION BY metadata__sheet ORDER BY source_row_index ROWS UNBOUNDED PRECEDING) AS metadata__athlete_name) FROM raw),
mk AS (
  SELECT *, metadata__episode_id <> 'ep_x' AS has_ep, coalesce(TRY_CAST(outcomes__score AS DOUBLE), 0) <> 0 AS has_res,
    maneuvering__indicator_01 + maneuvering__indicator_02 + maneuvering__indicator_03 + maneuvering__indicator_04 + kfv__indicator_01
      + kfv__indicator_07 + kfv__indicator_13 + kfv__indicator_19 + kfv__indicator_25 + vup__indicator_01 + vup__indicator_02
      + abs(coalesce(TRY_CAST(outcomes__score AS DOUBLE), 0)) + CAST(outcomes__finish_action_04 AS INTEGER) AS activity,
    coalesce(lower(metadata__athlete_name) LIKE '%итог%', false) AS agg FROM {source}
)"""


@query("c1_filled_names", with_cte(_FILLED.format(source="fill"), "SELECT source_row_index, metadata__athlete_name AS athlete_name FROM fill"))
def filled_names(spark, sf):
    rows = raw_rows(spark, sf).select("source_row_index", "metadata__sheet", "metadata__athlete_name")
    return cleaning.fill_names(rows, "source_row_index").select("source_row_index", F.col("metadata__athlete_name").alias("athlete_name"))


@query("c2_empty_rows", with_cte(RAW_CTE, """
SELECT source_row_index FROM raw WHERE metadata__bout_id = '' AND metadata__weight_class = '' AND metadata__opponent_name = ''"""))
def empty_rows(spark, sf):
    rows = raw_rows(spark, sf).select("source_row_index", "metadata__bout_id", "metadata__weight_class", "metadata__opponent_name")
    return rows.where(cleaning.is_empty_row(rows, ["source_row_index"])).select("source_row_index")


@query("c3_subtotal_rows", with_cte(RAW_CTE, "SELECT source_row_index FROM raw WHERE lower(metadata__athlete_name) LIKE '%итог%'"))
def subtotal_rows(spark, sf):
    return raw_rows(spark, sf).where(cleaning.is_aggregate_row("metadata__athlete_name")).select("source_row_index")


@query("c4_activity", with_cte(_FILLED.format(source="raw"), "SELECT source_row_index, round(activity, 6) AS activity FROM mk"))
def activity(spark, sf):
    rows = raw_rows(spark, sf)
    return rows.select("source_row_index", F.round(cleaning.activity(rows), 6).alias("activity"))


@query("c5_has_episode", with_cte(_FILLED.format(source="raw"), "SELECT source_row_index, has_ep AS has_episode FROM mk"))
def has_episode(spark, sf):
    return raw_rows(spark, sf).select("source_row_index", cleaning.has_episode("metadata__episode_id").alias("has_episode"))


@query("c6_has_result", with_cte(_FILLED.format(source="raw"), "SELECT source_row_index, has_res AS has_result FROM mk"))
def has_result(spark, sf):
    rows = raw_rows(spark, sf)
    return rows.select("source_row_index", cleaning.has_result(rows, "outcomes__score").alias("has_result"))


@query("c7_cleaning_report", with_cte(_FILLED.format(source="raw"), """
SELECT CASE WHEN agg THEN 'aggregate' WHEN NOT has_ep AND NOT has_res AND activity <= 0 THEN 'low_information' ELSE 'kept' END AS outcome,
  count(*) AS rows FROM mk GROUP BY 1"""))
def cleaning_report(spark, sf):
    return cleaning.cleaning_report(raw_rows(spark, sf))


@query("c8_clean_rows", with_cte(_FILLED.format(source="fill"), """
SELECT source_row_index, metadata__athlete_name AS athlete_name FROM mk WHERE NOT agg AND (has_ep OR has_res OR activity > 0)"""))
def clean_rows(spark, sf):
    return cleaning.clean(raw_rows(spark, sf)).select("source_row_index", F.col("metadata__athlete_name").alias("athlete_name"))


@query("c9_total_rows", with_cte(EPISODE_CTE, "SELECT source_row_index, is_total_row FROM epi"))
def total_rows(spark, sf):
    return field_rows(spark, sf).select("source_row_index", ep.is_total_row().alias("is_total_row"))


@query("c10_train_eligible", with_cte(EPISODE_CTE, "SELECT source_row_index, is_train_eligible FROM epi"))
def train_eligible(spark, sf):
    return episodes(spark, sf).select("source_row_index", "is_train_eligible")


# --- features --------------------------------------------------------------------------------

@query("f4_bitpack", with_cte(RAW_CTE, """
SELECT source_row_index, maneuvering__indicator_01 + 2 * maneuvering__indicator_02 + 4 * maneuvering__indicator_03 + 8 * maneuvering__indicator_04 AS mask FROM raw"""))
def bitpack(spark, sf):
    rows = raw_rows(spark, sf)
    flags = [coerce.indicator_flag_of(rows, f"maneuvering__indicator_{i:02d}") for i in range(1, 5)]
    return rows.select("source_row_index", features.bitpack(flags).alias("mask"))


@query("f5_log_bitpack", "SELECT event_id, round(log2(user_id % 64 + 1.0), 9) AS code FROM events")
def log_bitpack(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(features.log_of_mask(F.col("user_id") % 64), 9).alias("code"))


@query("f6_encoders", with_cte(RAW_CTE, """
, b AS (SELECT source_row_index, kfv__indicator_01 AS a, kfv__indicator_07 AS b, kfv__indicator_13 AS c FROM raw)
SELECT source_row_index, a + 2.0 * b + 4 * c AS bitpack, round(log2(a + 2.0 * b + 4 * c + 1), 9) AS log_bitpack, a + b + c AS "count",
  CAST(a + b + c > 0 AS INTEGER) AS "any" FROM b"""))
def encoders(spark, sf):
    rows = raw_rows(spark, sf)
    flags = [coerce.indicator_flag_of(rows, f"kfv__indicator_{i:02d}") for i in (1, 7, 13)]
    return rows.select("source_row_index", *[F.round(features.encode(flags, m), 9).alias(m) for m in ("bitpack", "log_bitpack", "count", "any")])


@query("f7_engineered_features", with_cte(FIELD_CTE, """
SELECT f.source_row_index, round(maneuver_right_code, 6) AS maneuver_right_code, round(maneuver_left_code, 6) AS maneuver_left_code,
  round(kfv_capture_code, 6) AS grips_code, round(kfv_post_code, 6) AS posts_code, round(vup_code, 6) AS vup_code,
  round(log2(1.0 + kfv__indicator_01 + 2 * kfv__indicator_07 + 4 * kfv__indicator_13 + 8 * kfv__indicator_19 + 16 * kfv__indicator_25), 6) AS kfv_code,
  round(log2(1.0 + CAST(f1 AS INTEGER) + 2 * CAST(f4 AS INTEGER) + 4 * CAST(f5 AS INTEGER)), 6) AS outcome_actions_code,
  episode_time_sec AS duration, pause_time_sec AS pause, score AS observed_result
FROM fld f JOIN obs o ON o.source_row_index = f.source_row_index"""))
def engineered(spark, sf):
    rows = features.engineer(raw_rows(spark, sf))
    codes = ["maneuver_right_code", "maneuver_left_code", "grips_code", "posts_code", "vup_code", "kfv_code", "outcome_actions_code"]
    return rows.select("source_row_index", *[F.round(c, 6).alias(c) for c in codes], "duration", "pause", "observed_result")


@query("f8_research_sequence_id", with_cte(RAW_CTE, """
SELECT source_row_index, CASE WHEN metadata__athlete_name <> '' THEN metadata__sheet || '::' || metadata__athlete_name
  ELSE metadata__sheet || '::' || metadata__episode_id END AS sequence_id,
  CASE WHEN metadata__athlete_name <> '' AND metadata__weight_class <> '' THEN metadata__athlete_name || '::' || metadata__weight_class
    WHEN metadata__athlete_name <> '' THEN metadata__athlete_name WHEN metadata__weight_class <> '' THEN metadata__weight_class
    ELSE 'sequence_0' END AS without_sheet FROM raw"""))
def research_sequence_id(spark, sf):
    athlete, sheet = F.col("metadata__athlete_name"), F.col("metadata__sheet")
    return raw_rows(spark, sf).select(
        "source_row_index", features.research_sequence_id(athlete, sheet, F.col("metadata__episode_id")).alias("sequence_id"),
        features.research_sequence_id(athlete, None, F.col("metadata__weight_class")).alias("without_sheet"),
    )


@query("f10_feature_variances", with_cte(FIELD_CTE, """
SELECT round(var_pop(maneuver_right_code), 6) AS maneuver_right_code, round(var_pop(vup_code), 6) AS vup_code,
  round(var_pop(kfv_post_code), 6) AS kfv_post_code, 0.0 AS constant FROM fld"""))
def feature_variances(spark, sf):
    rows = field_rows(spark, sf).withColumn("constant", F.lit(1.5))
    out = features.variances(rows, ["maneuver_right_code", "vup_code", "kfv_post_code", "constant"])
    return out.select([F.round(c, 6).alias(c) for c in out.columns])


@query("f12_hidden_layer", with_cte(FIELD_CTE, """
SELECT source_row_index, """ + ", ".join(f"round({c}, 6) AS {c}" for c in lx.HIDDEN_LAYER) + """, observed_zap_class FROM fld"""))
def hidden_layer(spark, sf):
    out = features.hidden_layer(field_rows(spark, sf), ["source_row_index"])
    return out.select("source_row_index", *[F.round(c, 6).alias(c) for c in lx.HIDDEN_LAYER], "observed_zap_class")


# --- canonical table ----------------------------------------------------------------------------

_TEXT = ["athlete_name", "athlete_id", "sheet_name", "weight_class", "opponent_name", "tournament_name", "event_date", "episode_id",
         "sequence_id", "sequence_quality_flag", "sequence_resolution_type", "sequence_quality_reason", "observed_zap_class",
         "observation_quality_flag", "observation_resolution_type", "observation_confidence_label", "score_supported_class",
         "source_record_id"]
_NUMS = ["episode_time_sec", "pause_time_sec", "score", "score_value", *lx.CODE_NAMES]


@query("e1_canonical_episodes", with_cte(EPISODE_CTE, f"""
SELECT source_row_index, {", ".join(_TEXT)}, {", ".join(f"round({c}, 6) AS {c}" for c in _NUMS)}, score_rounded, is_total_row, is_train_eligible,
  match_classes AS finish_match_classes FROM epi"""))
def canonical_episodes(spark, sf):
    return episodes(spark, sf).select(
        "source_row_index", *_TEXT, *[F.round(c, 6).alias(c) for c in _NUMS], "score_rounded", "is_total_row", "is_train_eligible",
        F.array_join("finish_match_classes", ",").alias("finish_match_classes"),
    )


@query("e3_weight_evidence", """
WITH v AS (
  SELECT 'metadata__kg_text' AS column_name, 60.0 + user_id % 5 * 10 AS value FROM events
  UNION ALL SELECT 'metadata__wt_noise', CASE WHEN user_id % 2 = 0 THEN value END FROM events),
s AS (SELECT column_name, count(value) AS numbers, count(value) / count(*) AS numeric_share,
  avg(CASE WHEN value BETWEEN 35 AND 200 THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END) AS in_range_share,
  count(DISTINCT round_even(value, 0)) AS distinct_values FROM v GROUP BY 1)
SELECT column_name, numbers, round(numeric_share, 6) AS numeric_share, round(in_range_share, 6) AS in_range_share, distinct_values,
  distinct_values > 1 AND in_range_share >= 0.8 AND distinct_values <= greatest(20, floor(numbers * 0.1)) AS looks_like_weight FROM s""")
def weight_evidence(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "string(60 + user_id % 5 * 10) AS metadata__kg_text", "CASE WHEN user_id % 2 = 0 THEN string(value) ELSE 'x' END AS metadata__wt_noise"
    )
    out = ep.weight_evidence(rows, ep.weight_candidates(rows.columns))
    return out.select("column_name", "numbers", F.round("numeric_share", 6).alias("numeric_share"),
                      F.round("in_range_share", 6).alias("in_range_share"), "distinct_values", "looks_like_weight")


@query("e4_canonical_codes", with_cte(FIELD_CTE, "SELECT source_row_index, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in lx.CODE_NAMES) + " FROM fld"))
def canonical_codes(spark, sf):
    return field_rows(spark, sf).select("source_row_index", *[F.round(c, 6).alias(c) for c in lx.CODE_NAMES])


@query("e5_row_identity", with_cte(RAW_CTE, """
SELECT source_row_index, metadata__sheet || '::' || CAST(source_row_index AS VARCHAR) AS source_record_id FROM raw"""))
def row_identity(spark, sf):
    return field_rows(spark, sf).select("source_row_index", F.concat_ws("::", "sheet_name", "source_row_index").alias("source_record_id"))


# --- joins and set operations -----------------------------------------------------------------------

@query("j1_aligned_rows", with_cte(ROW_ANALYSIS_CTE, """
SELECT source_row_index, athlete_name, round(vup_code, 6) AS vup_code, hidden_state, round(p_state_1, 6) AS p_state_1 FROM ra"""))
def aligned_rows(spark, sf):
    rows = row_analysis(spark, sf)
    out = ep.align(rows.select("source_row_index", "athlete_name"), rows.select("source_row_index", F.round("vup_code", 6).alias("vup_code")),
                   rows.select("source_row_index", "hidden_state", F.round("p_state_1", 6).alias("p_state_1")))
    return out


@query("j2_state_names", with_cte(ROW_ANALYSIS_CTE, """
SELECT source_row_index, CASE hidden_state WHEN 0 THEN 'S1' WHEN 1 THEN 'S2' ELSE 'state_2' END AS name FROM ra"""))
def named_rows(spark, sf):
    return row_analysis(spark, sf).select("source_row_index", state_name({0: "S1", 1: "S2"}, F.col("hidden_state")).alias("name"))


@query("j6_missing_fields", """
WITH present AS (SELECT DISTINCT event_type AS field FROM events)
SELECT f AS field FROM (VALUES ('view'), ('click'), ('refund'), ('error'), ('logout')) t(f) WHERE f NOT IN (SELECT field FROM present)""")
def missing_fields(spark, sf):
    wanted = spark.createDataFrame([(f,) for f in ("view", "click", "refund", "error", "logout")], "field string")
    present = table(spark, sf, "events").select(F.col("event_type").alias("field")).distinct()
    return wanted.join(present, "field", "left_anti")


@query("u2_unexpected_names", with_cte(ROW_ANALYSIS_CTE, "SELECT DISTINCT hidden_state_name AS name FROM ra WHERE hidden_state_name NOT IN ('S1', 'S9')"))
def unexpected(spark, sf):
    return unexpected_names(row_analysis(spark, sf), "hidden_state_name", ["S1", "S9"])


@query("u3_multiset_differences", with_cte(ROW_ANALYSIS_CTE, """
, a AS (SELECT hidden_state AS from_state, hidden_state AS to_state, count(*) AS "count" FROM ra GROUP BY 1),
b AS (SELECT hidden_state AS from_state, hidden_state AS to_state, count(*) FILTER (athlete_name <> '') AS "count" FROM ra GROUP BY 1)
SELECT *, 'stored_only' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT *, 'recomputed_only' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""))
def multiset_differences(spark, sf):
    rows = row_analysis(spark, sf)

    def counts(condition):
        per = rows.groupBy("hidden_state").agg(F.count(F.when(condition, 1)).alias("count"))
        return per.select(F.col("hidden_state").alias("from_state"), F.col("hidden_state").alias("to_state"), "count")

    return transition_differences(counts(F.lit(True)), counts(F.col("athlete_name") != ""))
