"""Models as parameter tables: one row per number, plus one row of facts."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..models.discrete import DiscreteModel, Training
from ..models.gaussian import GaussianModel
from ..operators.features import Scaler

NUMBERS = "model_id string, kind string, i int, j int, value double"
FACTS = "model_id string, family string, facts string"


def _rows(model_id: str, kind: str, values: np.ndarray) -> list[tuple]:
    m = np.atleast_2d(np.asarray(values, dtype=float))
    return [(model_id, kind, i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row)]


def discrete_table(spark: SparkSession, model: DiscreteModel, model_id: str) -> DataFrame:
    rows = _rows(model_id, "start", model.start) + _rows(model_id, "trans", model.trans) + _rows(model_id, "emit", model.emit)
    return spark.createDataFrame(rows, NUMBERS)


def gaussian_table(spark: SparkSession, model: GaussianModel, model_id: str) -> DataFrame:
    rows = _rows(model_id, "start", model.start) + _rows(model_id, "trans", model.trans) + _rows(model_id, "mean", model.means)
    rows += _rows(model_id, "cov", model.covs.reshape(model.n, -1))
    if model.scaler:
        rows += _rows(model_id, "scaler_mean", model.scaler.means) + _rows(model_id, "scaler_std", model.scaler.deviations)
        rows += _rows(model_id, "weight", model.scaler.weights)
    return spark.createDataFrame(rows, NUMBERS)


def save_model(spark: SparkSession, model, path: str, model_id: str, extra: dict | None = None) -> None:
    """Overwrite the numbers and the facts of one model under `path`."""
    facts = {
        "names": {str(k): v for k, v in model.names.items()}, "topology": model.topology, "min_forward": model.min_forward,
        "training": asdict(model.training) if model.training else None, "extra": extra or {},
    }
    if isinstance(model, DiscreteModel):
        family, table = "discrete", discrete_table(spark, model, model_id)
        facts["classes"] = model.classes
    else:
        family, table = "gaussian", gaussian_table(spark, model, model_id)
        facts["covariance"], facts["columns"] = model.covariance, model.scaler.columns if model.scaler else None
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/numbers")
    facts_row = [(model_id, family, json.dumps(facts, ensure_ascii=False))]
    spark.createDataFrame(facts_row, FACTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def load_model(spark: SparkSession, path: str):
    """The model and the extra facts saved with it."""
    family, text = spark.read.parquet(f"{path}/facts").select("family", "facts").first()
    facts = json.loads(text)
    cells: dict[str, dict] = {}
    for r in spark.read.parquet(f"{path}/numbers").collect():  # one row per model number
        cells.setdefault(r["kind"], {})[(r["i"], r["j"])] = r["value"]

    def matrix(kind: str) -> np.ndarray:
        found = cells[kind]
        out = np.zeros((1 + max(i for i, _ in found), 1 + max(j for _, j in found)))
        for (i, j), v in found.items():
            out[i, j] = v
        return out

    common = {
        "names": {int(k): v for k, v in facts["names"].items()}, "topology": facts["topology"],
        "min_forward": facts["min_forward"], "training": Training(**facts["training"]) if facts["training"] else None,
    }
    start, trans = matrix("start")[0], matrix("trans")
    if family == "discrete":
        return DiscreteModel(facts["classes"], start, trans, matrix("emit"), **common), facts["extra"]
    means = matrix("mean")
    scaler = None
    if facts["columns"]:
        numbers = (matrix(k)[0].tolist() for k in ("scaler_mean", "scaler_std", "weight"))
        scaler = Scaler(facts["columns"], *numbers)
    covs = matrix("cov").reshape(len(means), means.shape[1], means.shape[1])
    return GaussianModel(start, trans, means, covs, facts["covariance"], scaler=scaler, **common), facts["extra"]
