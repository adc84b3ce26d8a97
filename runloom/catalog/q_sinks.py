"""Queries: tables written and read back, saved models, run manifest, whole cycles."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..models import passes
from ..models.discrete import DiscreteModel
from ..operators import metadata_audit, sequence_audit
from ..operators.cleaning import clean
from ..operators.features import FeaturePlan, engineer, traceability, validation
from ..operators.tidy import MAPPING_SCHEMA, validate
from ..plans import diagnostics, research
from ..session import park, shared_folder
from ..sources import manifest, params, publish, sinks
from . import q_models
from .binding import EPISODE_CTE, RAW_CTE, analysis, episodes, raw_rows, with_cte
from .q_audits import _SEQ
from .registry import query


def scratch(spark, name):
    return f"{shared_folder(spark)}/runloom/{name}-{os.urandom(6).hex()}"


def published(spark, name, write):
    """A folder with one release of the tables that `write` makes."""
    folder = scratch(spark, name)
    release = publish.Release(spark, folder, "first")
    release.add(write(release.stage))
    release.publish()
    return folder


@query("s12_exported_rows", with_cte(RAW_CTE, """
SELECT count(*) AS rows, count(*) FILTER (metadata__athlete_name <> '') AS named, round(sum(metadata__episode_duration), 4) AS duration FROM raw"""))
def exported_rows(spark, sf):
    rows = raw_rows(spark, sf)
    mapping = spark.createDataFrame([(c, c, c.split("__")[0], i) for i, c in enumerate(rows.columns[1:], 1)], MAPPING_SCHEMA)
    folder = published(spark, "export", lambda stage: sinks.export_preprocessing(stage, rows, rows, mapping, validate(mapping, rows), fmt="csv"))
    back = spark.read.schema(rows.schema).csv(publish.path(spark, folder, "cleaned"), header=True)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("metadata__athlete_name") != "", 1)).alias("named"),
                    F.round(F.sum("metadata__episode_duration"), 4).alias("duration"))


@query("s13_exported_features", with_cte(RAW_CTE, """
SELECT round(sum(metadata__episode_duration), 4) AS duration, round(sum(log2(1.0 + vup__indicator_01 + 2 * vup__indicator_02)), 4) AS vup_code FROM raw"""))
def exported_features(spark, sf):
    rows = raw_rows(spark, sf)
    plan = FeaturePlan.from_names(rows.columns)
    made = engineer(rows, plan).select("source_row_index", *lx.ENGINEERED_FEATURES)
    folder = published(spark, "features", lambda stage: sinks.export_features(stage, rows, made, traceability(spark, plan), validation(spark, plan)))
    back = publish.read(spark, folder, "engineered_features")
    return back.agg(F.round(F.sum("duration"), 4).alias("duration"), F.round(F.sum("vup_code"), 4).alias("vup_code"))


@query("s14_exported_audits", with_cte(_SEQ, "SELECT n_sequences, CAST(sum(ns) AS BIGINT) AS rows FROM ls, (SELECT count(*) AS ns FROM an) GROUP BY 1"))
def exported_audits(spark, sf):
    rows = park(analysis(spark, sf), "analysis")
    audits = {"sequence": sequence_audit.audit(rows), "metadata": metadata_audit.audit(rows)}
    folder = published(spark, "audits", lambda stage: sinks.export_audits(stage, audits))
    back = publish.read(spark, folder, "sequence_summary", "json")
    return back.select("n_sequences", F.col("rows_total").alias("rows"))


_S, _M = q_models.S, q_models._M
_EPS = repr(q_models.EPS)
_MOVE = [[f"e.m{i}{j}" for j in _S] for i in _S]
#: Best paths under the model that the SQL EM ends with.
_SAVED = q_models._recursive(q_models.trained_sql(False) + f""",
pm AS MATERIALIZED (
  SELECT rid, pos, len, {", ".join(f"ln(greatest(e[{j * _M} + o + 1], {_EPS})) AS l{j}" for j in _S)},
    {", ".join(f"ln(greatest(p[{j + 1}], {_EPS})) AS i{j}" for j in _S)},
    {", ".join(f"ln(greatest(t[{i * 3 + j + 1}], {_EPS})) AS m{i}{j}" for i in _S for j in _S)} FROM seq, last),
fw AS (
  SELECT rid, pos, len, {", ".join(f"i{j} + l{j} AS d{j}" for j in _S)}, {", ".join(f"0 AS b{j}" for j in _S)} FROM pm WHERE pos = 1
  UNION ALL
  SELECT e.rid, e.pos, e.len, {", ".join("greatest(" + ", ".join(f"d{i} + {_MOVE[i][j]}" for i in _S) + f") + e.l{j}" for j in _S)},
    {", ".join(q_models._argmax(*[f"d{i} + {_MOVE[i][j]}" for i in _S]) for j in _S)}
  FROM fw JOIN pm e ON e.rid = fw.rid AND e.pos = fw.pos + 1),
bk AS (
  SELECT rid, pos, {q_models._argmax("d0", "d1", "d2")} AS s FROM fw WHERE pos = len
  UNION ALL
  SELECT fw.rid, fw.pos - 1, CASE bk.s WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END FROM bk JOIN fw ON fw.rid = bk.rid AND fw.pos = bk.pos WHERE bk.pos > 1)""",
    "SELECT CAST(s AS INT) AS hidden_state, count(*) AS n FROM bk GROUP BY 1")


@query("s15_saved_discrete_model", _SAVED)
def saved_discrete(spark, sf):
    """A trained model, saved, loaded and used to decode."""
    seg, rows = q_models._segments(spark, sf, cut=q_models.both)
    model = DiscreteModel.initial(3).fit(seg)
    seg.release()
    path = scratch(spark, "model")
    params.save_model(spark, model, path, "saved")
    loaded, _ = params.load_model(spark, path)
    return passes.decode(rows, loaded).groupBy("hidden_state").agg(F.count(F.lit(1)).alias("n"))


@query("s16_saved_gaussian_model")
def saved_gaussian(spark, sf):
    model, seg = q_models._gaussian_fit(spark, sf)
    seg.release()
    path = scratch(spark, "model")
    params.save_model(spark, model, path, "saved")
    loaded, _ = params.load_model(spark, path)
    return passes.decode(seg, loaded).groupBy("hidden_state").agg(F.count(F.lit(1)).alias("n"))


_PARAMETERS = {"n_states": 3, "topology": "left_to_right", "retrain": True}


@query("s17_run_manifest", with_cte(EPISODE_CTE, f"""
SELECT 'run' AS run_id, 'completed' AS status, sha256('{manifest.parameters_text(_PARAMETERS)}') AS fingerprint, count(*) AS number_of_episodes,
  count(*) FILTER (is_train_eligible) AS number_of_train_eligible_episodes, count(DISTINCT sequence_id) AS number_of_sequences FROM epi"""))
def run_manifest(spark, sf):
    rows = episodes(spark, sf)
    counts = rows.agg(
        F.count(F.lit(1)).alias("rows_total"), F.count(F.when(F.col("is_train_eligible"), 1)).alias("rows_train_eligible"),
        F.count_distinct("sequence_id").alias("n_sequences"),
    ).first().asDict()
    path = scratch(spark, "runs")
    manifest.append_status(spark, path, "run", "running", _PARAMETERS)
    manifest.append_status(spark, path, "run", "completed", _PARAMETERS, counts)
    return manifest.latest(spark, path).select(
        "run_id", "status", "fingerprint", "number_of_episodes", "number_of_train_eligible_episodes", "number_of_sequences"
    )


@query("d13_diagnostic_cycle")
def diagnostic_cycle(spark, sf):
    """Raw rows to a run summary, through training, decoding and all audits."""
    settings = diagnostics.Settings()
    return diagnostics.run(raw_rows(spark, sf), scratch(spark, "cycle"), settings).tables["run_summary"]


@query("d12_research_cycle")
def research_cycle(spark, sf):
    rows = park(clean(raw_rows(spark, sf)), "cleaned")
    return research.run(rows, scratch(spark, "research"), n_states=3).tables["state_profile"]
