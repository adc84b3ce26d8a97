"""Atomic publication of a run's tables.

A run writes into a folder of its own. Nobody reads there until one row is appended to
the list of releases: that row is the publication, and readers follow the newest one.
A run that is killed, fails or is still writing leaves the last complete release as it
was, and a reader never meets tables of two runs.
"""

from __future__ import annotations

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "version string, at timestamp, tables map<string, string>"


class Release:
    """Tables of one run: written under `stage`, listed by `add`, visible after `publish`."""

    def __init__(self, spark: SparkSession, folder: str, version: str):
        self.spark, self.folder, self.version = spark, folder, version
        self.stage = f"{folder}/versions/{version}"
        self.tables: dict[str, str] = {}

    def add(self, paths: dict[str, str], group: str = "") -> None:
        """Paths under `stage`, by name; kept relative, so that the whole folder can be moved."""
        for name, path in paths.items():
            if not path.startswith(self.stage + "/"):
                raise ValueError(f"{path} is not in {self.stage}")
            self.tables[f"{group}/{name}" if group else name] = path.removeprefix(self.folder + "/")

    def publish(self) -> None:
        """One file with one row: it is there or it is not."""
        row = (self.version, datetime.datetime.now(datetime.timezone.utc), self.tables)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/releases")


def current(spark: SparkSession, folder: str) -> dict[str, str]:
    """Paths of the newest release, by name; empty where nothing was published yet."""
    try:
        releases = spark.read.schema(SCHEMA).parquet(f"{folder}/releases")
        row = releases.agg(F.max(F.struct("at", "version")).alias("last")).first()["last"]
        if row is None:
            return {}
        tables = releases.where((F.col("at") == row["at"]) & (F.col("version") == row["version"])).first()["tables"]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return {}
    return {name: f"{folder}/{path}" for name, path in tables.items()}


def path(spark: SparkSession, folder: str, name: str) -> str:
    paths = current(spark, folder)
    if name not in paths:
        raise LookupError(f"nothing was published as {name!r} in {folder}")
    return paths[name]


def read(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A table of the newest release."""
    return spark.read.format(fmt).load(path(spark, folder, name))
