"""The research cycle: engineered features, a Gaussian model, decoded rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.gaussian import GaussianModel
from ..models.passes import decode
from ..models.runs import segments
from ..models.seeds import seed_means
from ..models.semantics import Naming, name_decoded
from ..operators import charts, picks, profiles, transitions
from ..operators.features import FeaturePlan, Scaler, block_weights, engineer, model_inputs, signal_source, with_research_keys
from ..operators.ordered import Ordering
from ..session import park
from ..sources import manifest, params, publish, sinks

MODES = ("full", "fast")


def order_of(df: DataFrame) -> Ordering:
    """Rows in table order; by sheet when there is one, which keeps sheets parallel."""
    return Ordering(("source_sheet",) if "source_sheet" in df.columns else (), "source_row_index").inspect(df)


def encode(cleaned: DataFrame, row: str = "source_row_index") -> tuple[DataFrame, FeaturePlan]:
    """Row id, keys and engineered features of cleaned rows."""
    plan = FeaturePlan.from_names([c for c in cleaned.columns if c != row])
    keyed = with_research_keys(engineer(cleaned, plan), plan, row)
    keys = [c for c in ("episode_id", "athlete_name", "source_sheet", "sequence_id") if c in keyed.columns]
    features = [c for c in ("maneuver_right_code", "maneuver_left_code", "grips_code", "holds_code", "bodylocks_code", "underhooks_code",
                            "posts_code", "kfv_code", "vup_code", "outcome_actions_code", "duration", "pause", "observed_result")]
    return keyed.select(F.col(row).alias("source_row_index"), *keys, *features), plan


def train(rows: DataFrame, n_states: int = 3, topology: str = "left_to_right", covariance: str = "diag", max_iter: int = 300,
          tol: float = 1e-2) -> tuple[GaussianModel, Naming, list[str]]:
    """Scale, seed, fit, name and order the states. Returns dropped constant columns too."""
    columns, dropped = model_inputs(rows)
    scaler = Scaler.fit(rows, columns, block_weights(columns))
    means, count = seed_means(rows, scaler, n_states, "source_row_index")
    if count < n_states:
        raise ValueError(f"{count} rows cannot carry {n_states} states")
    spread = rows.agg(*[F.var_pop(scaler.scaled(i)).alias(f"v{i}") for i in range(len(columns))]).first()
    model = GaussianModel.initial(means, np.array([float(v or 0.0) for v in spread]) + 0.01, covariance, topology, scaler=scaler)
    seg = segments(rows, order_of(rows), scaler.vector(), vector=True)
    model = model.fit(seg, max_iter, tol)
    states = decode(seg, model).select("source_row_index", "hidden_state")
    naming = name_decoded(rows.select("source_row_index", *columns).join(states, "source_row_index"), model.n)
    seg.release()
    return model.reordered(naming.order, naming.names), naming, dropped


def predict(rows: DataFrame, model: GaussianModel) -> DataFrame:
    """Rows with state, name, posteriors and confidence under a trained model."""
    missing = model.scaler.missing_from(rows)
    if missing:
        raise ValueError(f"columns the model needs are missing: {missing}")
    seg = segments(rows, order_of(rows), model.scaler.vector(), vector=True, passes=False)
    extra = [c for c in ("source_sheet", "run_no", "log_scale")]
    states = decode(seg, model).drop(*extra)
    return rows.join(states, "source_row_index").withColumn(
        "hidden_state_name", transitions.state_name(model.names, F.col("hidden_state"))
    )


@dataclass(frozen=True)
class Research:
    analysis: DataFrame
    model: GaussianModel
    tables: dict[str, DataFrame]
    signal: dict[str, object]


def run(cleaned: DataFrame, folder: str, mode: str = "full", n_states: int = 3, topology: str = "left_to_right",
        row: str = "source_row_index") -> Research:
    """`full` trains a model, `fast` uses the one published under `folder`; tables and model are published together."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = cleaned.sparkSession
    release = publish.Release(spark, folder, manifest.new_run_id())
    rows, plan = encode(cleaned, row)
    rows = park(rows, "features")
    if mode == "full":
        model, naming, _ = train(rows, n_states, topology)
        assigned, confidence = naming.assigned, naming.confidence
    else:
        model, extra = params.load_model(spark, publish.path(spark, folder, "model"))
        assigned, confidence = extra.get("assigned", {}), extra.get("confidence", {})
    params.save_model(spark, model, f"{release.stage}/model", "research", {"assigned": assigned, "confidence": confidence})
    release.add({"model": f"{release.stage}/model", "analysis": f"{release.stage}/analysis"})
    analysis = spark.read.parquet(sinks.write_table(predict(rows, model), f"{release.stage}/analysis"))
    moves = park(transitions.named_transitions(transitions.count_transitions(analysis, order_of(analysis)), model.names), "moves")
    recomputed = transitions.count_transitions(analysis, order_of(analysis))
    profile = profiles.feature_profile(analysis, [c for c in rows.columns if c.endswith("_code") or c in ("duration", "pause", "observed_result")],
                                       model.names)
    tables = {
        "transitions": moves,
        "directions": transitions.direction_shares(moves),
        "transition_differences": transitions.transition_differences(moves, recomputed),
        "unexpected_names": transitions.unexpected_names(analysis, "hidden_state_name", list(model.names.values())),
        "state_profile": profile,
        "interpretation": profiles.interpret_states(profile, assigned, confidence),
        "summary_lines": profiles.summary_lines(profile),
        "sample": picks.sample_row(analysis),
        **{f"chart_{k}": v for k, v in charts.chart_tables(
            analysis if "athlete_name" in analysis.columns else analysis.withColumn("athlete_name", F.lit("")),
            transitions.top_transitions(moves), model.names).items()},
    }
    release.add(sinks.write_tables(tables, f"{release.stage}/tables"), "tables")
    release.publish()
    return Research(analysis, model, tables, signal_source(plan))
