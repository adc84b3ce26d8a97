"""Short ways in: train a model, analyze rows with it, and pick one episode."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..models.gaussian import GaussianModel
from ..operators import cleaning, picks
from ..session import park
from ..sources import cells as cs
from ..sources import params
from . import research


def load_rows(cells: DataFrame, depth: int = 2, mode: str = "auto", sheets: str | list[str] | None = None) -> DataFrame:
    """Cleaned rows with their raw header names; features are found by header words."""
    rows = park(cs.read_sheets(cells, depth, mode, sheets)["rows"], "rows")
    return cleaning.clean(rows)


def train(rows: DataFrame, path: str, n_states: int = 3, topology: str = "left_to_right") -> GaussianModel:
    features = park(research.encode(rows)[0], "features")
    model, naming, _ = research.train(features, n_states, topology)
    params.save_model(rows.sparkSession, model, path, "facade", {"assigned": naming.assigned, "confidence": naming.confidence})
    return model


def analyze(rows: DataFrame, path: str) -> DataFrame:
    model, _ = params.load_model(rows.sparkSession, path)
    return research.predict(research.encode(rows)[0], model)


def demo(rows: DataFrame, path: str, episode: int | None = None, retrain: bool = False, **how) -> tuple[DataFrame, DataFrame]:
    """Train unless a model is there, analyze, and return the insight row with it."""
    spark = rows.sparkSession
    if retrain or not _exists(spark, f"{path}/facts"):
        train(rows, path, **how)
    analysis = park(analyze(rows, path), "analysis")
    return analysis, picks.insight(analysis, episode)


def _exists(spark, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
