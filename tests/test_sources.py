import pytest
from pyspark.sql import functions as F

from runloom import session
from runloom.sources import cells as cs
from runloom.sources import manifest, series, sinks


def grid(spark, sheets):
    rows = [(name, r, c, v) for name, table in sheets.items() for r, line in enumerate(table) for c, v in enumerate(line) if v is not None]
    return spark.createDataFrame([(s, r, c, str(v)) for s, r, c, v in rows], cs.CELL_SCHEMA)


TABLE = [
    ["ФИО", "Эпизод", None, "Баллы", None, "note", "Unnamed: 6"],
    ["борца", "номер", "время", "x", "x", None, None],
    ["Иванов", 1, 30, 2, "да", "", "z"],
    ["Петров", 2, 25, 0, 0, None, None],
]
MATRIX = [
    ["ФИО борца", None, "Сидоров А."],
    [None, None, None],
    [None, "№ эпизода", 1, 2, "3а"],
    [None, "Время эпизода", "10,5", 20, None],
    [None, "Время паузы", 1, None, 3],
    [None, "Баллы", 0, 1, 4],
    [None, "Правосторонняя стойка", "да", "нет", 1],
    [None, "Захваты", 1, 0, 0],
    [None, "Захваты рукава", 0, 1, 0],
    [None, "Прихваты", None, "yes", 2],
    [None, "Хваты", 0, 0, 0],
    [None, "ВУП", 0, -1, 0.5],
    [None, "Пустая строка", None, None, None],
    [None, "Атакующие приёмы", 0, 0, "истина"],
]


def test_header_names(spark):
    names = {r["col_idx"]: r["name"] for r in cs.header_names(grid(spark, {"s": TABLE}), 2).collect()}
    assert names == {
        0: "фио | борца", 1: "эпизод | номер", 2: "эпизод | время", 3: "баллы | x", 4: "баллы | x_2", 5: "note", 6: "note_2",
    }


def test_table_rows_and_selection(spark):
    cells = grid(spark, {"a": TABLE, "b": TABLE[:3]})
    rows = cs.read_sheets(cells, 2, "table")["rows"]
    assert rows.count() == 3 and sorted(r["source_row_index"] for r in rows.select("source_row_index").collect()) == [0, 1, 2]
    only = cs.read_sheets(cells, 2, "table", "b")["rows"]
    assert [r["_sheet"] for r in only.collect()] == ["b"]
    with pytest.raises(ValueError, match="no such sheet"):
        cs.select_sheets(cells, ["a", "zzz"])
    with pytest.raises(ValueError, match="mode"):
        cs.read_sheets(cells, 2, "guess")
    with pytest.raises(ValueError, match="not a matrix sheet"):
        cs.read_sheets(cells, 2, "matrix")


def test_matrix_sheet(spark):
    cells = grid(spark, {"m": MATRIX, "t": TABLE})
    assert [r["sheet"] for r in cs.matrix_sheets(cells).collect()] == ["m"]
    one = cells.where("sheet = 'm'")
    rows = cs.matrix_rows(cs.parse_matrix(one), cs.athlete_names(one, cs.axis_of(one))).orderBy("episode_order").collect()
    assert [r["episode_id"] for r in rows] == ["1", "2"]  # an id with a Cyrillic letter is none here
    assert rows[0]["athlete_name"] == "Сидоров А." and rows[0]["episode_duration"] == 10.5 and rows[1]["observed_result"] == 1.0
    assert rows[0]["maneuver_right_indicator_01"] == 1 and rows[1]["kfv_grips_indicator_02"] == 1 and rows[1]["kfv_underhooks_indicator_01"] == 1
    assert rows[1]["vup_indicator_01"] == 1  # `-1` loses its sign in the label form
    kinds = {r["normalized_column"] for r in cs.parse_matrix(one).mapping.collect()}
    assert "unknown_indicator_01" not in kinds and "kfv_holds_indicator_01" in kinds and "outcome_action_indicator_01" in kinds


def test_matrix_sheet_far_from_the_top(spark):
    """Marker in row 30 and column 10, label rows 200 rows below it, name in row 28, and a sheet with a marker in every row."""
    top = [["note"]] * 28 + [[None] * 20 + ["ФИО борца", None, "Сидоров А."], [None]]
    shifted = [[None] * 9 + r for r in MATRIX[2:3]] + [[None]] * 200 + [[None] * 9 + r for r in MATRIX[3:]]
    markers = [["№ эпизода", 1, 2]] * 2
    cells = grid(spark, {"m": top + shifted, "t": TABLE, "few": markers})
    assert [r["sheet"] for r in cs.matrix_sheets(cells).collect()] == ["m"]
    one = cells.where("sheet = 'm'")
    assert [tuple(r) for r in cs.athlete_names(one, cs.axis_of(one)).collect()] == [("m", "Сидоров А.")]
    rows = cs.read_sheets(cells, 2)["rows"].where("_sheet = 'm'").collect()
    assert {r["athlete_name"] for r in rows} == {"Сидоров А."} and len(rows) == 2


def test_cells_are_not_broadcast(spark, monkeypatch):
    """Exploded cells look small to the planner. Only tables of few rows, by count, are broadcast; the rows are the same."""
    flat = [(r, c, str(v)) for r, line in enumerate(MATRIX) for c, v in enumerate(line) if v is not None]
    parts = spark.createDataFrame(flat, "row_idx int, col_idx int, value string").select(F.array_agg(F.struct("*")).alias("p"))
    cells = parts.select(F.explode("p").alias("c")).crossJoin(spark.range(3)).selectExpr("concat('m', id) AS sheet", "c.*")

    def found():
        matrix = cs.parse_matrix(cells)
        tables = [cs.matrix_sheets(cells), cs.row_labels(cells, matrix.axis), cs.athlete_names(cells, matrix.axis), matrix.values,
                  cs.matrix_rows(matrix, cs.athlete_names(cells, matrix.axis))]
        plans = [t._jdf.queryExecution().sparkPlan().toString() for t in tables]
        return ["BroadcastHashJoin" in p for p in plans], [sorted(map(repr, t.collect())) for t in tables]

    few, rows = found()
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    many, same = found()
    assert any(few) and not any(many) and rows == same and [len(r) for r in rows[:1]] == [3] and len(rows[4]) == 6


def test_contact_parts_of_a_matrix_sheet(spark):
    """Columns keep their part, so the codes of that part are not zero; the export has rows and labels."""
    from runloom.operators.features import FeaturePlan
    from runloom.operators.tidy import tidy
    from runloom.plans.diagnostics import blocks_of

    read = cs.read_sheets(grid(spark, {"m": MATRIX}), 2)
    rows = read["rows"].drop("episode_order", "source_sheet")
    found = tidy(rows, blocks=blocks_of(rows.columns))
    plan = FeaturePlan.from_names([t for _, t, _, _ in found.mapping])
    assert plan.inputs["grips_code"] == ["kfv__grips_indicator_01", "kfv__grips_indicator_02"]
    assert plan.inputs["underhooks_code"] == ["kfv__underhooks_indicator_01"] and plan.inputs["holds_code"] == ["kfv__holds_indicator_01"]
    assert plan.inputs["maneuver_right_code"] == ["maneuvering__maneuver_right_indicator_01"]
    assert found.rows.agg(F.sum("kfv__grips_indicator_02")).first()[0] == 1


def test_both_kinds_in_one_table(spark):
    read = cs.read_sheets(grid(spark, {"m": MATRIX, "t": TABLE}), 2)
    rows = read["rows"].orderBy("source_row_index").collect()
    assert [r["source_row_index"] for r in rows] == list(range(len(rows))) and {r["_sheet"] for r in rows} == {"m", "t"}
    assert read["label_mapping"].count() == 10


def test_labels(spark):
    df = spark.createDataFrame([(["A b", None, "a  b", "", "Ёж!"],)], "x array<string>")
    assert df.select(cs.compose_label(F.col("x"))).first()[0] == "a b | еж"
    order = spark.createDataFrame([("Обхваты",), ("Прихваты",), ("Захваты",), ("Хваты",), ("эпизод №",), ("?",)], "x string")
    assert [r[0] for r in order.select(cs.label_kind(F.col("x"))).collect()] == [
        "kfv_bodylocks_indicator", "kfv_underhooks_indicator", "kfv_grips_indicator", "kfv_holds_indicator", "episode_id", "unknown_indicator"]


def test_sinks_and_series(spark, tmp_path):
    df = spark.createDataFrame([("2020-01", 1.5, ["a"]), ("2020-03", 2.5, [])], "date string, cash_inflow double, tags array<string>")
    path = sinks.write_table(df, str(tmp_path / "csv"), "csv")
    back = series.read_series(spark, path, "date string, cash_inflow double, tags string", "one").orderBy("t").collect()
    assert str(back[1]["date"]) == "2020-03-01" and back[1]["t"] - back[0]["t"] == 2 and back[0]["tags"] == '["a"]'
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "x"), "xlsx")


def test_run_manifest(spark, tmp_path):
    path = str(tmp_path / "runs")
    manifest.append_status(spark, path, "r1", "running", {"b": 1, "a": "я"})
    manifest.append_status(spark, path, "r1", "failed", {"a": "я", "b": 1}, error="boom")
    rows = manifest.latest(spark, path).collect()
    assert len(rows) == 1 and rows[0]["status"] == "failed" and rows[0]["error"] == "boom"
    assert manifest.fingerprint({"b": 1, "a": "я"}) == manifest.fingerprint({"a": "я", "b": 1}) == rows[0]["fingerprint"]
