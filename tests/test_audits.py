import pytest
from pyspark.sql import functions as F

from runloom.operators import charts, health, metadata_audit, observation_audit, picks, profiles, regime_tables, sequence_audit
from runloom.operators.episodes import FieldPlan
from runloom.operators.observation import observe


def test_observation_audit(spark):
    rows = [("5", 0, 0, 1), ("1", 1, 0, 0), ("0", 0, 0, 0), (None, 0, 0, 0), ("2", 0, 1, 0), ("0", 0, 0, 0)]
    names = ["outcomes__score", "outcomes__finish_action_04_05", "outcomes__finish_action_05_06", "custom_finish_signal"]
    df = spark.createDataFrame(rows, f"{names[0]} string, {names[1]} int, {names[2]} int, {names[3]} int")
    audit = observation_audit.audit(observe(df), names=names)
    s = audit["summary"].first()
    assert s["rows_total"] == 6 and s["unsupported_scores"] == [5] and s["unsupported_finish_columns"] == ["custom_finish_signal"]
    assert s["mapped_finish_positive_rows"] == 2 and s["unmapped_finish_positive_rows"] == 1 and s["mapping_gap_detected"]
    assert s["hold_positive_rows"] == 1 and "unsupported_scores" in s["warnings"]
    values = audit["unsupported_values"].collect()
    assert {(r["raw_value"], r["rows"]) for r in values} == {("0", 5), ("1", 1)}
    assert round(sum(r["share"] for r in audit["crosstab"].collect()), 9) == 1.0


def test_metadata_audit(spark):
    df = spark.createDataFrame(
        [(i, "a" if i else "b", "", 0.0, 0.0, float(i), f"seq{i}") for i in range(3)],
        "source_row_index long, athlete_name string, weight_class string, episode_time_sec double, pause_time_sec double, score double, sequence_id string",
    )
    out = metadata_audit.audit(df, FieldPlan.from_names(df.columns))
    s = out["summary"].first()
    assert "opponent_name" in s["missing_fields"] and s["segmentation_readiness"] == "partial" and s["temporal_readiness"] == "weak"
    assert {"weight_class_weak", "episode_time_weak", "opponent_name_missing"} <= set(s["warnings"])
    field = {r["field"]: r for r in out["field_coverage"].collect()}
    assert len(field) == 12 and field["athlete_name"]["sample_values"] == ["b", "a"] and field["score"]["zero_share"] == pytest.approx(1 / 3)
    assert field["event_date"]["missing_share"] == 1.0 and not field["event_date"]["available_in_canonical"]


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(i, "long", "surrogate", "medium", "surrogate_partial_context", "no_score", 0) for i in range(60)]
    rows += [(60 + i, "short", "surrogate", "low", "surrogate_no_context", "hold" if i else "zap_r", i % 2) for i in range(5)]
    return spark.createDataFrame(rows, "source_row_index long, sequence_id string, sequence_resolution_type string, sequence_quality_flag string, "
                                       "sequence_quality_reason string, observed_zap_class string, hidden_state int").cache()


def test_sequence_audit(runs):
    audit = sequence_audit.audit(runs)
    found = {r["sequence_id"]: r["suspicion_reasons"] for r in audit["suspicious_sequences"].collect()}
    assert found["long"] == ["flat_observed_and_hidden", "mostly_no_score_flat_sequence", "suspiciously_long_sequence"]
    assert found["short"] == ["low_quality_segmentation"]
    s = audit["summary"].first()
    assert s["n_sequences"] == 2 and s["long_sequence_threshold"] == 58 and s["potential_multi_bout_ids"] == ["long"]
    assert s["median"] == 32.5 and s["p95"] == pytest.approx(57.25) and s["surrogate_based_segmentation"]


def one_row(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_health_and_recommendation(spark):
    df = spark.createDataFrame([(i, 0 if i < 95 else 1, 0.9, 0.9, 0.05, 0.05) for i in range(100)],
                               "source_row_index long, hidden_state int, confidence double, p_state_0 double, p_state_1 double, p_state_2 double")
    moves = spark.createDataFrame([(0, 0, 99), (0, 1, 1)], "from_state int, to_state int, count long")
    profile = spark.createDataFrame([("maneuvering",), ("kfv",)], "key_link string")
    observed = one_row(spark, direct_share=0.5, no_score_rule_share=0.1, ambiguous_share=0.0, unknown_share=0.0)
    quality = one_row(spark, surrogate_sequence_share=0.2, explicit_sequence_share=0.8)
    names = {"S1": 0, "S2": 1, "S3": 2}
    bad = health.model_health(df, moves, profile, observed, 3, {"S1": 0}, {"S1": 0.9})
    h = bad.first()
    assert h["self_transition_share"] == pytest.approx(0.99) and h["degenerate_transition_warning"] and h["semantic_quality"] == "partial"
    assert h["effective_state_usage"] == pytest.approx(2 / 3) and "semantics_partial" in h["warnings"]
    ballot = health.votes(df, names)
    assert health.recommend(ballot, bad, observed, quality).first()["reason"] == "semantics_partial"
    sure = {"S1": 0.5, "S2": 0.5, "S3": 0.5}
    stuck = health.model_health(df, moves, profile, observed, 3, names, sure)
    assert health.recommend(ballot, stuck, observed, quality).first()["reason"] == "degenerate_transitions"
    lively = spark.createDataFrame([(0, 0, 50), (0, 1, 50)], "from_state int, to_state int, count long")
    fine = health.model_health(df, lively, profile, observed, 3, names, sure)
    advice = health.recommend(ballot, fine, observed, quality).first()
    assert advice["profile"] == "maneuvering-dominant" and advice["consensus_votes"] == 3
    poor = one_row(spark, direct_share=0.01, no_score_rule_share=0.8, ambiguous_share=0.0, unknown_share=0.0)
    assert health.recommend(ballot, fine, poor, quality).first()["reason"] == "weak_data"


def test_dominant_state_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([(0, 2), (1, 1), (2, 1), (3, 2)], "source_row_index long, hidden_state int")
    assert profiles.dominant_by_coverage(df).first()["state"] == 2
    assert profiles.dominant_by_coverage(df.where("false")).first()["state"] == -1


def test_insight_row(spark):
    rows = [(0, "1", "", 0, 0.0, 0.0), (1, "2", "q", 1, 0.0, 1.0), (2, "", "q", 1, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "source_row_index long, episode_id string, sequence_id string, hidden_state int, observed_result double, vup_code double")
    df = df.withColumn("hidden_state_name", F.lit("S"))
    assert picks.insight(df).first()["source_row_index"] == 1
    assert picks.insight_row(df, 99).first()["source_row_index"] == 2 and picks.insight_row(df, -5).first()["source_row_index"] == 0
    empty = df.where("source_row_index = 0")
    first = picks.insight(empty).first()
    assert first["selection_reason"] == "auto_fallback_zero" and first["message"] == "nearly_empty_episode"
    assert picks.sample_row(df).first()["source_row_index"] == 1 and picks.sample_row(empty).first()["warning"] == "ids_missing"


def test_charts(spark):
    df = spark.createDataFrame([(0, 0, "S1", "a", 1.0, 0.7, 0.3), (1, 1, "S2", "b", 0.0, 0.2, 0.8), (2, 1, "S2", "a", 0.0, 0.4, 0.6)],
                               "source_row_index long, hidden_state int, hidden_state_name string, athlete_name string, observed_result double, p_state_0 double, p_state_1 double")
    assert {(r["hidden_state_name"], r["successful"], r["unsuccessful"]) for r in charts.success_counts(df).collect()} == {("S1", 1, 0), ("S2", 0, 2)}
    assert charts.posterior_points(df, {0: "S1"}).where("label = 'state_1'").count() == 3
    top = charts.athlete_comparison(df, [0, 1], 1).collect()
    assert len(top) == 1 and top[0]["athlete_name"] == "a" and top[0]["share_state_0"] == 0.5


def test_event_matches(spark):
    days = spark.createDataFrame([("2020-01-15",), ("2020-02-15",), ("2020-02-16",), ("2020-03-31",)], "d string").select(F.to_date("d").alias("date"))
    events = spark.createDataFrame([("2020-01-15", "x"), ("2020-02-29", "y")], "d string, description string").select(F.to_date("d").alias("event_date"), "description")
    found = {(str(r["date"]), r["description"], r["is_event"]) for r in regime_tables.near_events(days, events).collect()}
    assert found == {("2020-01-15", "x", True), ("2020-02-15", "x", False), ("2020-02-15", "y", False), ("2020-02-16", "y", False)}


def test_regime_labels(spark):
    df = spark.createDataFrame([(0, 90.0, 0.05, 10.0, 30.0), (1, 50.0, 0.3, 45.0, 80.0)],
                               "state int, cash_inflow double, overdue_ratio double, avg_payment_delay_days double, contract_terms_index double")
    labels = [r["interpretation"] for r in regime_tables.payment_regimes(df, "state").orderBy("state").collect()]
    assert labels == ["NORMAL - Low overdue, Quick payments, Favorable terms", "SIGNIFICANT DECLINE - High overdue, Significant delays, Unfavorable terms"]
