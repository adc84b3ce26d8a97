"""The diagnostic cycle: raw rows to decoded episodes, audits and a recommendation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..models.discrete import DiscreteModel, class_number
from ..models.passes import decode
from ..models.runs import both, segments
from ..models.semantics import Naming, name_decoded, names_table
from ..operators import charts, cleaning, health, metadata_audit, observation_audit, profiles, sequence_audit, transitions
from ..operators.episodes import FieldPlan, build_episodes, provenance
from ..operators.features import FeaturePlan, engineer, semantic_view, traceability, validation
from ..operators.observation import ObservationRules, observe
from ..operators.ordered import Ordering
from ..operators.tidy import Tidy, tidy, validate
from ..session import park
from ..sources import cells as cs
from ..sources import manifest, params, publish, sinks

SHEET = ("sheet_name",)


@dataclass(frozen=True)
class Settings:
    n_states: int = 3
    topology: str = "left_to_right"
    max_iter: int = 300
    tol: float = 1e-4
    match_on: str = "normalized"  # or "source": match finish rules on the header text
    retrain: bool = True
    model_path: str | None = None
    field_map: dict[str, str] = field(default_factory=dict)
    across_sheets: bool = False


@dataclass(frozen=True)
class Prepared:
    """Cleaned rows with codes and observed classes, and the canonical table."""

    tidy: Tidy
    cleaned: DataFrame
    episodes: DataFrame
    fields: FieldPlan
    features: FeaturePlan
    names: list[str]


def prepare(rows: DataFrame, settings: Settings = Settings(), rules: ObservationRules | None = None, row: str = "source_row_index",
            blocks: dict[str, str] | None = None) -> Prepared:
    """Type, clean, classify and cut the rows. The classified rows and the canonical table are written once each."""
    tidied = tidy(rows, row, blocks=blocks)
    cleaned = cleaning.clean(tidied.rows, row, settings.across_sheets)
    names = [c for c in cleaned.columns if c != row]
    labels = tidied.labels() if settings.match_on == "source" else None
    plan = FeaturePlan.from_names(names)
    full = park(engineer(observe(cleaned, rules, names, labels), plan), "observed")  # the audits and exports read it many times
    fields = FieldPlan.from_names(names, settings.field_map).with_guessed_weight(full.select(*[F.col(f"`{c}`") for c in cleaned.columns]))
    episodes = park(build_episodes(full, fields, row), "episodes")
    return Prepared(tidied, full, episodes, fields, plan, names)


def train(episodes: DataFrame, settings: Settings = Settings(), classes: list[str] | None = None) -> tuple[DiscreteModel, Naming]:
    """EM on eligible rows, then names from the features, then the states in their order.

    Runs are numbered after the filter, so rows on both sides of a dropped one meet.
    """
    classes = classes or lx.OBSERVED_CLASSES
    rows = episodes.where("is_train_eligible")
    if rows.isEmpty():
        raise ValueError("no row is eligible for training")
    order = Ordering(SHEET, "source_row_index").inspect(rows)
    seg, every = both(rows, order, class_number(F.col("observed_zap_class"), classes))
    model = DiscreteModel.initial(settings.n_states, classes, settings.topology).fit(seg, settings.max_iter, settings.tol)
    seg.release()
    states = decode(every, model).select("source_row_index", "hidden_state")
    naming = name_decoded(semantic_view(rows).join(states, "source_row_index"), model.n)
    return model.reordered(naming.order, naming.names), naming


def analyze(episodes: DataFrame, model: DiscreteModel) -> DataFrame:
    """Episodes with their decoded state, posteriors, confidence and observed result."""
    order = Ordering(SHEET, "source_row_index").inspect(episodes)
    seg = segments(episodes, order, class_number(F.col("observed_zap_class"), model.classes), passes=False)
    states = decode(seg, model).drop(*SHEET, "run_no", "log_scale")
    out = episodes.join(states, "source_row_index")
    return out.withColumn("hidden_state_name", transitions.state_name(model.names, F.col("hidden_state"))).withColumn(
        "observed_result", F.col("score")
    )


@dataclass(frozen=True)
class Report:
    analysis: DataFrame
    model: DiscreteModel
    tables: dict[str, DataFrame]
    audits: dict[str, dict[str, DataFrame]]
    charts: dict[str, DataFrame]


def report(prepared: Prepared, analysis: DataFrame, model: DiscreteModel, assigned: dict[str, int], confidence: dict[str, float],
           rules: ObservationRules | None = None) -> Report:
    """Every summary table. `analysis` should be a written table: it is read many times."""
    order = Ordering(SHEET, "source_row_index").inspect(analysis)
    moves = park(transitions.named_transitions(transitions.count_transitions(analysis, order), model.names), "moves")
    # a row, or a row per state, each read by several of the tables below
    profile = park(profiles.state_profile(analysis), "profile")
    observed, quality = park(profiles.observed_layer(analysis), "observed"), park(profiles.sequence_quality(analysis), "quality")
    audits = {
        "observation": observation_audit.audit(prepared.cleaned, rules, prepared.names),
        "metadata": metadata_audit.audit(prepared.episodes, prepared.fields),
        "sequence": sequence_audit.audit(analysis, prepared.fields.columns, prepared.fields.columns["explicit_sequence_id"]),
    }
    state = park(health.model_health(analysis, moves, profile, observed, model.n, assigned, confidence), "health")
    advice = park(health.recommend(health.votes(analysis, assigned), state, observed, quality), "advice")
    flags = health.report_flags(audits["observation"]["summary"], observed, quality, state, audits["metadata"]["summary"])
    tables = {
        "transitions": moves, "directions": transitions.direction_shares(moves), "state_profile": profile,
        "observed_layer": observed, "sequence_quality": quality, "recommendation": advice, "report_flags": flags,
        "run_summary": park(health.run_summary(analysis, observed, quality, state, advice), "summary"),
    }
    audits["model"] = {"summary": state}
    shown = charts.chart_tables(analysis, transitions.top_transitions(moves), model.names)
    return Report(analysis, model, tables, audits, shown)


def run(rows: DataFrame, folder: str, settings: Settings = Settings(), rules: ObservationRules | None = None,
        row: str = "source_row_index", blocks: dict[str, str] | None = None, extra: dict[str, DataFrame] | None = None) -> Report:
    """The whole cycle, with a run table under `folder`. A failure is recorded and raised.

    Readers see the tables of a run, the model included, when all of them are written
    (`publish.read`); `extra` tables go along with the preprocessing ones.
    """
    spark, run_id, runs = rows.sparkSession, manifest.new_run_id(), f"{folder}/runs"
    parameters = {"n_states": settings.n_states, "topology": settings.topology, "match_on": settings.match_on,
                  "retrain": settings.retrain, "model_path": settings.model_path}
    manifest.append_status(spark, runs, run_id, "running", parameters)
    release = publish.Release(spark, folder, run_id)
    stage = release.stage
    try:
        prepared = prepare(rows, settings, rules, row, blocks)
        if settings.retrain:
            model, naming = train(prepared.episodes, settings)
            assigned, confidence = naming.assigned, naming.confidence
            model_path = settings.model_path or f"{stage}/model"
            params.save_model(spark, model, model_path, run_id, {"assigned": assigned, "confidence": confidence})
            names = names_table(spark, naming)
        else:
            published = publish.current(spark, folder)
            model_path = settings.model_path or publish.path(spark, folder, "model")
            model, more = params.load_model(spark, model_path)
            assigned, confidence = more.get("assigned", {}), more.get("confidence", {})
            names = spark.read.parquet(published["state_names"]) if "state_names" in published else None
            if not settings.model_path:  # a release holds all that its tables rest on
                model_path = f"{stage}/model"
                params.save_model(spark, model, model_path, run_id, {"assigned": assigned, "confidence": confidence})
        if names is not None:
            release.add(sinks.write_tables({"state_names": names}, stage))
        if not settings.model_path:
            release.add({"model": model_path})
        path = sinks.write_table(analyze(prepared.episodes, model), f"{stage}/analysis")
        release.add({"analysis": path})
        out = report(prepared, spark.read.parquet(path), model, assigned, confidence, rules)
        mapping = prepared.tidy.mapping_table(spark)
        release.add(sinks.export_preprocessing(
            f"{stage}/preprocessing", rows, prepared.cleaned.select(row, *prepared.names), mapping, validate(mapping, prepared.cleaned),
            {"episodes": prepared.episodes, "fields": provenance(spark, prepared.fields), **(extra or {})}), "preprocessing")
        release.add(sinks.export_features(
            f"{stage}/features", prepared.cleaned.select(row, *prepared.features.raw_columns()),
            prepared.cleaned.select(row, *lx.ENGINEERED_FEATURES), traceability(spark, prepared.features), validation(spark, prepared.features)),
            "features")
        release.add(sinks.export_audits(f"{stage}/audits", out.audits), "audits")
        release.add(sinks.write_tables(out.tables, f"{stage}/tables"), "tables")
        release.add(sinks.write_tables(out.charts, f"{stage}/charts"), "charts")
        counts = out.tables["run_summary"].first().asDict()
        release.publish()
        manifest.append_status(spark, runs, run_id, "completed", parameters, counts)
        return out
    except Exception as error:
        manifest.append_status(spark, runs, run_id, "failed", parameters, error=f"{type(error).__name__}: {error}")
        raise


def run_cells(cells: DataFrame, folder: str, settings: Settings = Settings(), depth: int = 2, mode: str = "auto",
              sheets: str | list[str] | None = None, rules: ObservationRules | None = None) -> Report:
    """The cycle from a cell table. Matrix sheets bring their own blocks for grip columns."""
    read = cs.read_sheets(cells, depth, mode, sheets)
    rows = read["rows"].drop("episode_order")
    if "source_sheet" in rows.columns:
        rows = rows.drop("source_sheet")
    extra = {name: read[name] for name in ("matrix_rows", "label_mapping") if name in read}
    return run(park(rows, "rows"), folder, settings, rules, blocks=blocks_of(rows.columns), extra=extra)


def blocks_of(columns: list[str]) -> dict[str, str]:
    """Blocks that a matrix sheet's own column kinds tell."""
    parts = {"kfv_": "kfv", "maneuver_": "maneuvering"}
    return {c: block for c in columns for start, block in parts.items() if c.startswith(start) and "_indicator_" in c}
