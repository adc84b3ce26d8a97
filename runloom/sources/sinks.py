"""Writers: one table per result, Parquet by default; a failed write fails the run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "json")


def _flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for CSV."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select([
        F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema
    ])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    writer = (_flat(df) if fmt == "csv" else df).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    return {name: write_table(df, f"{folder}/{name}", fmt) for name, df in tables.items()}


def export_preprocessing(folder: str, raw: DataFrame, cleaned: DataFrame, mapping: DataFrame, validation: DataFrame,
                         extra: dict[str, DataFrame] | None = None, fmt: str = "parquet") -> dict[str, str]:
    tables = {"raw": raw, "cleaned": cleaned, "mapping": mapping, **(extra or {})}
    paths = write_tables(tables, folder, fmt)
    return {**paths, "validation": write_table(validation, f"{folder}/validation", "json")}


def export_features(folder: str, raw: DataFrame, engineered: DataFrame, trace: DataFrame, validation: DataFrame,
                    fmt: str = "parquet") -> dict[str, str]:
    paths = write_tables({"raw_features": raw, "engineered_features": engineered, "traceability": trace}, folder, fmt)
    return {**paths, "feature_validation": write_table(validation, f"{folder}/feature_validation", "json")}


def export_audits(folder: str, audits: dict[str, dict[str, DataFrame]], fmt: str = "parquet") -> dict[str, str]:
    """Audit name → its tables; one-row summaries are written as JSON."""
    paths = {}
    for audit, tables in audits.items():
        for name, df in tables.items():
            kind = "json" if name == "summary" else fmt
            paths[f"{audit}_{name}"] = write_table(df, f"{folder}/{audit}_{name}", kind)
    return paths
