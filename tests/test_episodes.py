import pytest
from pyspark.sql import functions as F

from runloom.functions import lexicon as lx
from runloom.operators import cleaning, features
from runloom.operators.episodes import FieldPlan, align, build_episodes
from runloom.operators.observation import ObservationRules, finish_columns, mapped_classes, observe
from runloom.operators.tidy import tidy, validate


def classes(spark, rows, schema):
    return observe(spark.createDataFrame(rows, schema)).collect()


def test_decision_table(spark):
    rows = [("1", 0, 0), ("1", 1, 0), ("4", 1, 0), ("0", 1, 1), (None, 0, 0), ("0", 0, 0), ("5", 0, 0), ("0,4", 0, 0), ("2,4", 0, 0), ("2.5", 0, 0)]
    found = classes(spark, rows, "outcomes__score string, outcomes__finish_action_01 int, outcomes__finish_action_04 int")
    assert [r["observed_zap_class"] for r in found] == [
        "zap_r", "zap_r", "zap_r", "unknown", "unknown", "no_score", "unknown", "unknown", "zap_n", "zap_n"]
    assert [r["observation_quality_flag"] for r in found] == [
        "ok_score_rule", "ok_finish_rule", "ok_finish_rule_score_mismatch", "unknown_ambiguous_finish",
        "unknown_missing_score_and_finish", "ok_no_score_rule", "unknown_unsupported_score", "unknown_unsupported_score",
        "ok_score_rule", "ok_score_rule"]
    assert found[3]["finish_match_classes"] == ["hold", "zap_r"] and found[3]["observation_confidence_label"] == "low"
    assert found[1]["observed_zap_source_columns"] == ["outcomes__finish_action_01", "outcomes__score"]


def test_class_names_of_columns():
    rules = ObservationRules()
    assert mapped_classes("Болевой на руку", rules) == ["arm_submission"]
    assert mapped_classes("outcomes__finish_action_06", rules) == ["leg_submission"]
    assert mapped_classes("threshold", rules) == ["hold"]  # words are found anywhere in the name
    assert finish_columns(["outcomes__f05"], rules, {"outcomes__f05": "удержание"}) == {"outcomes__f05": ["hold"]}


def test_no_score_column_at_all(spark):
    found = classes(spark, [("x",)], "note string")
    assert found[0]["observed_zap_class"] == "unknown" and found[0]["score_value"] is None


def test_cleaning_drops_subtotals_and_empty_rows(spark):
    rows = [(0, "Иванов", "1", "2", 0), (1, None, "2", "0", 1), (2, "Итого", "", "9", 0), (3, "Петров", "эпизод", "0", 0), (4, "Петров", "x", "0", 3)]
    df = spark.createDataFrame(rows, "source_row_index long, athlete_name string, episode_id string, outcomes__score string, kfv__f01 int")
    df = df.withColumn("_sheet", F.lit("48"))
    kept = cleaning.clean(df).orderBy("source_row_index").collect()
    assert [(r["source_row_index"], r["athlete_name"]) for r in kept] == [(0, "Иванов"), (1, "Иванов"), (4, "Петров")]
    report = {r["outcome"]: r["rows"] for r in cleaning.cleaning_report(df).collect()}
    assert report == {"kept": 3, "aggregate": 1, "low_information": 1}


def test_fill_stays_in_the_sheet_unless_asked(spark):
    df = spark.createDataFrame([(0, "a", "x"), (1, "b", ""), (2, "b", "y")], "source_row_index long, _sheet string, athlete_name string")
    inside = cleaning.fill_names(df, "source_row_index").orderBy("source_row_index").collect()
    across = cleaning.fill_names(df, "source_row_index", True, block=1).orderBy("source_row_index").collect()
    assert [r["athlete_name"] for r in inside] == ["x", None, "y"] and [r["athlete_name"] for r in across] == ["x", "x", "y"]


def test_null_columns(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert cleaning.drop_null_columns(df).columns == ["a"]


def test_tidy_types_and_structure(spark):
    df = spark.createDataFrame([(0, "Иванов", "2", "да", None), (1, None, None, None, None)], "source_row_index long, `ФИО борца` string, `Баллы` string, `кфв x` string, `note` string")
    result = tidy(df)
    assert result.rows.count() == 1
    row = result.rows.first()
    assert row["metadata__athlete_name"] == "Иванов" and row["outcomes__score"] == 2.0 and row["kfv__f01"] == 0.0 and row["other__f01"] == ""
    check = validate(result.mapping_table(spark), result.rows).first()
    assert not check["is_valid"] and check["missing_blocks"] == ["maneuvering", "vup"] and check["row_count"] == 1


def test_bit_codes(spark):
    wide = [f"maneuvering__indicator_{i:02d}" for i in range(1, 25)] + [f"kfv__indicator_{i:02d}" for i in range(1, 30)]
    wide += [f"vup__indicator_{i:02d}" for i in range(1, 6)] + [f"outcomes__finish_action_{i:02d}" for i in range(1, 7)]
    on = {"maneuvering__indicator_01", "kfv__indicator_01", "kfv__indicator_07", "kfv__indicator_13", "kfv__indicator_19", "kfv__indicator_25"}
    df = spark.createDataFrame([tuple(int(c in on) for c in wide), tuple(0 for _ in wide)], ", ".join(f"{c} int" for c in wide))
    out = features.engineer(df).collect()
    for code in ("maneuver_right_code", "grips_code", "holds_code", "bodylocks_code", "underhooks_code", "posts_code"):
        assert out[0][code] == 1.0 and out[1][code] == 0.0
    assert out[0]["maneuver_left_code"] == 0.0 and out[0]["kfv_code"] > 20
    plan = features.FeaturePlan.from_names(wide)
    assert plan.missing_groups() == [] and len(plan.inputs["maneuver_right_code"]) == 12 and len(plan.trace_rows()) == 13
    with pytest.raises(ValueError):
        features.bitpack([F.lit(1)] * 63)
    with pytest.raises(ValueError):
        features.encode([F.lit(1)], "median")


def test_log_of_masks(spark):
    df = spark.createDataFrame([(0,), (1,), (3,), (5,)], "m int")
    assert [round(r[0], 6) for r in df.select(features.log_of_mask(F.col("m"))).collect()] == [0.0, 1.0, 2.0, 2.584963]


def test_sequence_key_precedence(spark):
    df = spark.createDataFrame([("a", "s", "e"), ("a", "", "e"), ("a", "", ""), ("", "s", "e"), ("", "s", ""), ("", "", "e"), (None, None, None)], "a string, s string, e string")
    found = [r[0] for r in df.select(features.research_sequence_id(F.col("a"), F.col("s"), F.col("e"))).collect()]
    assert found == ["s::a", "a::e", "a", "s::e", "s", "e", "sequence_0"]


def test_model_inputs_leave_outcomes_and_constants_out(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, 1.0), (2.0, 2.0, 6.0, 0.0)], "kfv_code double, vup_code double, outcome_actions_code double, observed_result double")
    assert features.model_inputs(df) == (["kfv_code"], ["vup_code"])
    flat = df.select(F.lit(1.0).alias("kfv_code"))
    assert features.model_inputs(flat) == (["kfv_code"], [])


def test_scaler_and_weights(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "duration double, pause double")
    scaler = features.Scaler.fit(df, ["duration", "pause"], features.block_weights(["duration", "pause"]))
    got = [r[0] for r in df.select(scaler.vector()).collect()]
    assert got[0][0] == pytest.approx(-0.9 / 2**0.5) and got[0][1] == 0.0


def test_episode_table(spark):
    df = spark.createDataFrame([(0, "48", "A-3", "3"), (1, "48", "Итого", "1")], "source_row_index long, sheet string, episode_id string, outcomes__score string")
    names = [c for c in df.columns if c != "source_row_index"]
    out = build_episodes(observe(df, names=names), FieldPlan.from_names(names)).orderBy("source_row_index").collect()
    assert out[0].asDict().keys() == set(lx.EPISODE_COLUMNS) and out[0]["source_record_id"] == "48::0"
    assert out[0]["athlete_id"].startswith("ath_") and out[1]["is_total_row"] and not out[1]["is_train_eligible"]


def test_field_fallbacks():
    cols = ["metadata__episode_attr_02", "metadata__episode_attr_03", "metadata__episode_attr_04"]
    plan = FieldPlan.from_names(cols)
    assert plan.columns["episode_id"] == "metadata__episode_attr_02" and plan.methods["episode_id"] == "positional_episode_attr"
    assert plan.columns["episode_time_sec"] == "metadata__episode_attr_03" and plan.columns["pause_time_sec"] == "metadata__episode_attr_04"
    assert FieldPlan.from_names(["metadata__athlete_name"]).columns["athlete_id"] == "metadata__athlete_name"
    assert FieldPlan.from_names(["metadata__athlete_name"], distinct_athlete_id=True).columns["athlete_id"] is None


def test_guessed_weight(spark):
    df = spark.createDataFrame([(str(48 + i % 3), i) for i in range(40)], "metadata__kg string, metadata__x int")
    assert FieldPlan.from_names(["metadata__x"]).with_guessed_weight(df.withColumnRenamed("metadata__kg", "metadata__wt_text")).columns["weight_class"] == "metadata__wt_text"


def test_align_needs_equal_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "source_row_index long, v string")
    b = spark.createDataFrame([(1, 10), (2, 20)], "source_row_index long, w int")
    c = spark.createDataFrame([(2, 0.5, 7), (1, 0.25, 8)], "source_row_index long, z double, w int")
    found = align(a, b, c)
    assert found.columns == ["source_row_index", "v", "w", "z"] and sorted(map(tuple, found.collect())) == [(1, "x", 10, 0.25), (2, "y", 20, 0.5)]
    assert align(a).collect() == a.collect()
    more = spark.createDataFrame([(3, 1)], "source_row_index long, w int")
    none = spark.createDataFrame([(None, 1), (1, 1), (2, 1)], "source_row_index long, w int")
    lost, added, doubled = b.where("w < 20"), b.union(more), b.union(b.where("w = 10"))
    for bad in (lost, added, doubled, none, b.limit(0)):
        for tables in ((a, bad), (a, b, bad.withColumnRenamed("w", "u"))):
            with pytest.raises(Exception, match="do not hold the same rows"):
                align(*tables).collect()
    with pytest.raises(Exception, match="do not hold the same rows"):
        align(a.union(a), b).select("w").collect()