"""Queries: worksheets as cells, header names, matrix sheets, series, sinks, manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce
from ..operators.ordered import Ordering, with_place
from ..session import park
from ..sources import cells as cs
from .binding import table, view, with_cte
from .registry import query

# Matrix sheets `m<user>` hold one column per event; table sheets `t<user % 4>` one row per event.
_EV = "event_id, user_id, event_type, value, int(regexp_extract(props, '([0-9]+)', 1)) AS k"
_LABELS = [
    (3, None, "Время эпизода", "string(round(value, 1))"),
    (4, None, "Время паузы", "concat(k, ',5')"),
    (5, None, "Баллы", "string(k % 5)"),
    (6, None, "Правосторонняя стойка", "CASE WHEN k % 2 = 1 THEN 'да' ELSE 'нет' END"),
    (7, None, "Левосторонняя стойка", "CASE WHEN k % 3 = 0 THEN '1' ELSE '0' END"),
    (8, "Захваты", "рукав", "CASE WHEN k % 5 = 0 THEN 'yes' END"),
    (9, None, "пояс", "CASE WHEN k % 7 = 0 THEN '2' ELSE '' END"),
    (10, "Обхваты", "корпус", "CASE WHEN k < 50 THEN 'истина' ELSE 'x' END"),
    (11, "Броски", "ВУП (n или n1)", "CASE WHEN k % 4 = 0 THEN '0.5' ELSE '-2' END"),
    (12, None, "Завершающие приёмы", "CASE WHEN k > 90 THEN 'True' ELSE 'no' END"),
]
_HEADERS = ["ФИО борца", "Технико-тактический  эпизод", "Технико-тактический эпизод", "Баллы",
            *["Стойка и маневрирование самбиста (основные в эпизоде)"] * 2, "Вес", ""]
_BODY = ["concat('u', user_id)", "string(event_id)", "string(value)", "string(k % 5)", "string(k % 2)", "string(k % 3)",
         "string(60 + k % 40)", "event_type"]


@view
def matrix_cells(spark, sf):
    events = table(spark, sf, "events").selectExpr(*_EV.split(", ", 4)[:4], _EV.split(", ", 4)[4])
    placed = with_place(events, Ordering(("user_id",), "event_id").inspect(events), "place")
    sheet = "concat('m', user_id) AS sheet"
    column = [(2, "string(place)"), *[(at, text) for at, _, _, text in _LABELS]]
    data = placed.selectExpr(sheet, "int(place + 1) AS col_idx", "explode(array(" + ", ".join(
        f"struct(int({at}) AS row_idx, string({text}) AS value)" for at, text in column) + ")) AS c")
    data = data.select("sheet", "c.row_idx", "col_idx", "c.value")
    fixed = [(0, 0, "'ФИО борца:'"), (0, 1, "concat('u', user_id)"), (2, 0, "'Параметры'"), (2, 1, "'№ эпизода'")]
    fixed += [(at, c, f"'{t}'") for at, first, second, _ in _LABELS for c, t in ((0, first), (1, second)) if t]
    users = events.select("user_id").distinct()
    heads = users.selectExpr(sheet, "explode(array(" + ", ".join(
        f"struct(int({r}) AS row_idx, int({c}) AS col_idx, {v} AS value)" for r, c, v in fixed) + ")) AS c").select("sheet", "c.*")
    return heads.unionByName(data)


@view
def table_cells(spark, sf):
    events = table(spark, sf, "events").selectExpr(*_EV.split(", ", 4)[:4], _EV.split(", ", 4)[4])
    body = "explode(array(" + ", ".join(f"struct({i} AS col_idx, {v} AS value)" for i, v in enumerate(_BODY)) + ")) AS c"
    heads = "explode(array(" + ", ".join(f"struct({i} AS col_idx, '{v}' AS value)" for i, v in enumerate(_HEADERS)) + ")) AS c"
    rows = events.selectExpr("concat('t', user_id % 4) AS sheet", "int(event_id + 1) AS row_idx", body)
    top = events.selectExpr("concat('t', user_id % 4) AS sheet", "0 AS row_idx").distinct().selectExpr("*", heads)
    return top.unionByName(rows).select("sheet", "row_idx", "c.*")


def all_cells(spark, sf):
    """The cell table as an import would leave it: written once."""
    return park(_all_cells(spark, sf), "cells")


def _all_cells(spark, sf):
    return matrix_cells(spark, sf).unionByName(table_cells(spark, sf))


_CTE = """
e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, count(*) OVER (PARTITION BY user_id) AS many FROM events)"""


@query("s1_rows_per_sheet", with_cte(_CTE, """
SELECT 'm' || user_id AS sheet, count(*) AS rows FROM e WHERE many >= 2 GROUP BY 1
UNION ALL SELECT 't' || (user_id % 4), count(*) FROM e GROUP BY 1
UNION ALL SELECT 'm' || user_id, 11 FROM e WHERE many < 2"""))
def rows_per_sheet(spark, sf):
    rows = cs.read_sheets(all_cells(spark, sf), depth=1)["rows"]
    return rows.groupBy(F.col("_sheet").alias("sheet")).agg(F.count(F.lit(1)).alias("rows"))


@query("s2_selected_sheets", with_cte(_CTE, """
SELECT 't' || (user_id % 4) AS sheet, 8 * (count(*) + 1) AS cells FROM e WHERE user_id % 4 IN (1, 3) GROUP BY 1"""))
def selected_sheets(spark, sf):
    return cs.select_sheets(_all_cells(spark, sf), ["t1", "t3"]).groupBy("sheet").agg(F.count(F.lit(1)).alias("cells"))


@query("s3_header_names", """
SELECT 't' || s AS sheet, i AS col_idx, ['фио борца', 'технико-тактический эпизод', 'технико-тактический эпизод_2', 'баллы',
  'стойка и маневрирование самбиста (основные в эпизоде)', 'стойка и маневрирование самбиста (основные в эпизоде)_2', 'вес',
  'unknown_column'][i + 1] AS name
FROM (SELECT DISTINCT user_id % 4 AS s FROM events), range(8) r(i)""")
def header_names(spark, sf):
    return cs.header_names(table_cells(spark, sf), 1)


@query("s4_matrix_sheets", with_cte(_CTE, "SELECT DISTINCT 'm' || user_id AS sheet FROM e WHERE many >= 2"))
def matrix_sheets(spark, sf):
    return cs.matrix_sheets(all_cells(spark, sf))


_FEATURES = ["episode_duration", "pause_duration", "observed_result", "maneuver_right_indicator_01", "maneuver_left_indicator_01",
             "kfv_grips_indicator_01", "kfv_grips_indicator_02", "kfv_bodylocks_indicator_01", "vup_indicator_01",
             "outcome_action_indicator_01"]


@query("s5_matrix_rows", with_cte(_CTE, """
SELECT 'm' || user_id AS source_sheet, place AS episode_order, CAST(place AS VARCHAR) AS episode_id, 'u' || user_id AS athlete_name,
  round(value, 1) AS episode_duration, k + 0.5 AS pause_duration, CAST(k % 5 AS DOUBLE) AS observed_result,
  CAST(k % 2 = 1 AS INTEGER) AS maneuver_right_indicator_01, CAST(k % 3 = 0 AS INTEGER) AS maneuver_left_indicator_01,
  CAST(k % 5 = 0 AS INTEGER) AS kfv_grips_indicator_01, CAST(k % 7 = 0 AS INTEGER) AS kfv_grips_indicator_02,
  CAST(k < 50 AS INTEGER) AS kfv_bodylocks_indicator_01, CAST(k % 4 = 0 AS INTEGER) AS vup_indicator_01,
  CAST(k > 90 AS INTEGER) AS outcome_action_indicator_01 FROM e"""))
def matrix_rows(spark, sf):
    cells = park(matrix_cells(spark, sf), "cells")
    matrix = cs.parse_matrix(cells)
    return cs.matrix_rows(matrix, cs.athlete_names(cells, matrix.axis), _FEATURES)


_KINDS = ", ".join(f"({at}, '{kind}')" for at, kind in zip(range(3, 13), [
    "episode_duration", "pause_duration", "observed_result", "maneuver_right_indicator", "maneuver_left_indicator",
    "kfv_grips_indicator", "kfv_grips_indicator", "kfv_bodylocks_indicator", "vup_indicator", "outcome_action_indicator"]))
_TEXTS = ", ".join(f"({at}, '{text}')" for at, text in zip(range(3, 13), [
    "параметры | время эпизода", "параметры | время паузы", "параметры | баллы", "параметры | правосторонняя стойка",
    "параметры | левосторонняя стойка", "захваты | рукав", "захваты | пояс", "обхваты | корпус", "броски | вуп n или n1",
    "броски | завершающие приемы"]))


@query("s6_label_kinds", f"""
SELECT 'm' || user_id AS sheet, row_idx, kind FROM (SELECT DISTINCT user_id FROM events), (VALUES {_KINDS}) v(row_idx, kind)""")
def label_kinds(spark, sf):
    cells = matrix_cells(spark, sf)
    return cs.row_labels(cells, cs.axis_of(cells)).select("sheet", "row_idx", cs.label_kind(F.col("source_label")).alias("kind"))


@query("s7_composed_labels", f"""
SELECT 'm' || user_id AS sheet, row_idx, label AS source_label FROM (SELECT DISTINCT user_id FROM events), (VALUES {_TEXTS}) v(row_idx, label)""")
def composed_labels(spark, sf):
    cells = matrix_cells(spark, sf)
    return cs.row_labels(cells, cs.axis_of(cells))


@query("s8_athlete_names", "SELECT DISTINCT 'm' || user_id AS sheet, 'u' || user_id AS athlete_name FROM events")
def athlete_names(spark, sf):
    cells = matrix_cells(spark, sf)
    return cs.athlete_names(cells, cs.axis_of(cells))


@query("s9_label_mapping", with_cte(_CTE, f""",
used AS (
  SELECT user_id, row_idx FROM (SELECT DISTINCT user_id FROM e), range(3, 13) r(row_idx)
  WHERE row_idx NOT IN (8, 9) OR (row_idx = 8 AND user_id IN (SELECT user_id FROM e WHERE k % 5 = 0))
    OR (row_idx = 9 AND user_id IN (SELECT user_id FROM e WHERE k % 7 = 0))
)
SELECT 'm' || user_id AS sheet, CASE WHEN row_idx <= 5 THEN kind ELSE kind || '_' || printf('%02d', CAST(row_number()
  OVER (PARTITION BY user_id, kind ORDER BY row_idx) AS INTEGER)) END AS normalized_column,
  CASE WHEN row_idx <= 5 THEN 'numeric' ELSE 'binary' END AS parser_kind FROM used JOIN (VALUES {_KINDS}) v(row_idx, kind) USING (row_idx)"""))
def label_mapping(spark, sf):
    return cs.parse_matrix(park(matrix_cells(spark, sf), "cells")).mapping.select("sheet", "normalized_column", "parser_kind")


@query("s10_numbered_rows", with_cte(_CTE, """
SELECT 't' || (user_id % 4) AS _sheet, CAST(event_id AS VARCHAR) AS id,
  row_number() OVER (ORDER BY user_id % 4, event_id) - 1 AS source_row_index FROM e"""))
def numbered_rows(spark, sf):
    rows = cs.number_rows(cs.table_rows(table_cells(spark, sf), 1), "_sheet", "row_idx")
    return rows.select("_sheet", F.col("`технико-тактический эпизод`").alias("id"), "source_row_index")


@query("u1_union_of_sheets", with_cte(_CTE, """
SELECT count(*) AS rows, count(*) FILTER (m) AS matrix_rows, sum(s) AS scores FROM (
  SELECT true AS m, k % 5 AS s FROM e WHERE many >= 2 UNION ALL SELECT false, k % 5 FROM e UNION ALL SELECT false, NULL FROM e, range(11) WHERE many < 2)"""))
def union_of_sheets(spark, sf):
    rows = cs.read_sheets(all_cells(spark, sf), depth=1)["rows"]
    scores = F.coalesce(coerce.number(F.col("`баллы`")), F.col("observed_result").cast("double"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count("source_sheet").alias("matrix_rows"), F.sum(scores).cast("long").alias("scores"))
