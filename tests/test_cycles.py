"""Whole cycles on small tables, and queries against their SQL twins."""

import random

import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from runloom import catalog
from runloom.catalog.binding import raw_rows
from runloom.plans import diagnostics, facade, research
from runloom.sources import cells as cs
from runloom.sources import publish, sinks


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(7)
    heads = ["ФИО борца", "Номер эпизода", "Баллы", *["стойка и маневрирование самбиста (основные в эпизоде)"] * 2,
             *["контакты физического взаимодействия (захваты, обхваты, прихваты, хваты, упоры)"] * 2,
             "выведение соперника из устойчивого положения (при выполнении n или n1)", *["завершающие атаку приемы (n)"] * 4]
    rows = []
    for sheet in ("48", "52"):
        rows += [(sheet, 0, c, h) for c, h in enumerate(heads)]
        for r in range(1, 41):
            values = [f"Борец {r // 12}", str(r % 6 + 1), str(rng.choice([0, 0, 1, 2, 4])), *[str(rng.randint(0, 1)) for _ in heads[3:-4]],
                      "0", "0", "0", "1" if rng.random() < 0.2 else "0"]
            rows += [(sheet, r, c, v) for c, v in enumerate(values)]
    return spark.createDataFrame(rows, cs.CELL_SCHEMA)


def test_diagnostic_cycle(spark, cells, tmp_path):
    folder = str(tmp_path)
    out = diagnostics.run_cells(cells, folder, diagnostics.Settings(max_iter=6), depth=1)
    summary = out.tables["run_summary"].first()
    assert summary["rows_total"] == 80 and 0 < summary["rows_train_eligible"] <= 80 and summary["n_sequences"] > 2
    assert out.analysis.count() == 80 and {"hidden_state", "p_state_2", "confidence"} <= set(out.analysis.columns)
    assert publish.read(spark, folder, "tables/transitions").count() > 0
    first = publish.current(spark, folder)
    assert {"model", "state_names", "analysis", "preprocessing/episodes", "features/traceability", "audits/model_summary"} <= set(first)
    status = [r["status"] for r in spark.read.parquet(f"{folder}/runs").orderBy("at").collect()]
    assert status == ["running", "completed"]
    again = diagnostics.run_cells(cells, folder, diagnostics.Settings(retrain=False), depth=1)
    assert [r["hidden_state"] for r in again.analysis.orderBy("source_row_index").collect()] == [
        r["hidden_state"] for r in publish.read(spark, folder, "analysis").orderBy("source_row_index").collect()]
    second = publish.current(spark, folder)
    assert set(second) == set(first) and not set(second.values()) & set(first.values())


def test_killed_run_leaves_the_last_release(spark, tmp_path):
    """A reader sees all tables of one run or of the other, whatever a later run has written so far."""
    folder, made = str(tmp_path), lambda n: spark.createDataFrame([(n,)], "n int")
    assert publish.current(spark, folder) == {}
    with pytest.raises(LookupError):
        publish.read(spark, folder, "a")
    for version in (1, 2):
        release = publish.Release(spark, folder, f"v{version}")
        release.add(sinks.write_tables({"a": made(version), "b": made(version)}, release.stage), "tables")
        if version == 1:
            release.publish()
        else:  # the second run dies before it is published, with some tables written
            half = publish.Release(spark, folder, "v3")
            sinks.write_tables({"a": made(3)}, half.stage)
        assert [publish.read(spark, folder, f"tables/{t}").first().n for t in "ab"] == [1, 1]
    release.publish()
    assert [publish.read(spark, folder, f"tables/{t}").first().n for t in "ab"] == [2, 2]
    with pytest.raises(ValueError):
        release.add({"x": f"{folder}/elsewhere"})


def test_failed_run_is_recorded(spark, tmp_path):
    bad = spark.createDataFrame([(0, "Итого")], "source_row_index long, `ФИО борца` string")
    with pytest.raises(ValueError):
        diagnostics.run(bad, str(tmp_path))
    assert "failed" in [r["status"] for r in spark.read.parquet(f"{tmp_path}/runs").collect()] and publish.current(spark, str(tmp_path)) == {}


def test_research_and_facade(spark, cells, tmp_path):
    rows = facade.load_rows(cells, 1)
    analysis, insight = facade.demo(rows, str(tmp_path / "model"))
    assert analysis.count() == 80 and insight.count() == 1
    shares = [r[0] for r in analysis.select(F.round(F.col("p_state_0") + F.col("p_state_1") + F.col("p_state_2"), 6)).collect()]
    assert set(shares) == {1.0}
    out = research.run(rows, str(tmp_path / "research"))
    assert out.tables["transition_differences"].count() == 0 and out.tables["unexpected_names"].count() == 0
    assert out.signal["classification"] == "proxy"
    fast = research.run(rows, str(tmp_path / "research"), "fast")
    assert fast.analysis.count() == 80 and "tables/summary_lines" in publish.current(spark, str(tmp_path / "research"))


SAMPLE = [
    "o6_observed_class", "w1_sequence_assignment", "w2_run_lengths", "w3_transition_summary", "c8_clean_rows", "e1_canonical_episodes",
    "f7_engineered_features", "a17_sequence_table", "d3_field_quality", "d5_sequence_audit", "h4_expected_counts", "h10_prediction",
    "s5_matrix_rows", "j4_rows_near_events", "n10_episode_number", "t5_sample_values",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, name):
    _, _, same, note = compare(spark, connect(sf), name, catalog.queries()[name], catalog.oracle_sql()[name], sf)
    assert same, note


def test_every_twin_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_a_cycle_cleans_its_rows_once(spark, tmp_path):
    """Every audit and export reads the classified rows from a written table; the input is read for these and for the raw export only."""
    seen = spark.sparkContext.accumulator(0)

    def reads(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = raw_rows(spark, "/root/testdata/sf0.001").where("source_row_index < 200")
    n = source.count()
    out = diagnostics.run(source.mapInArrow(reads, source.schema), str(tmp_path), diagnostics.Settings(max_iter=2))
    assert out.tables["run_summary"].first()["rows_total"] == out.analysis.count() > 0
    assert n < seen.value <= 6 * n
    prepared = diagnostics.prepare(source)
    assert "Window" not in prepared.cleaned._jdf.queryExecution().toString()
