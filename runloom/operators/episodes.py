"""The canonical episode table: one typed row per episode, 38 columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce, lexicon as lx
from ..functions.names import episode_attributes, neighbour_attribute, resolve
from .observation import OBSERVATION_COLUMNS
from .sequences import assign_sequences


@dataclass(frozen=True)
class FieldPlan:
    """Logical field → source column, and how it was found. Made from names only."""

    columns: dict[str, str | None]
    methods: dict[str, str]

    @classmethod
    def from_names(cls, names: list[str], given: dict[str, str] | None = None,
                   distinct_athlete_id: bool = False) -> "FieldPlan":
        """`given` pins fields to columns. With `distinct_athlete_id` the id may
        not fall back on the column already bound to the athlete's name."""
        columns: dict[str, str | None] = {}
        methods: dict[str, str] = {}
        for name, candidates in lx.FIELD_CANDIDATES.items():
            columns[name], methods[name] = resolve(names, candidates)
        columns.update(given or {})
        methods.update({k: "given" for k in given or {}})
        if distinct_athlete_id and columns["athlete_id"] == columns["athlete_name"]:
            columns["athlete_id"] = None
        if columns["athlete_id"] is None:
            methods["athlete_id"] = "surrogate_from_athlete_name"

        def fall_back(name: str, column: str | None, method: str) -> None:
            if columns[name] is None and column is not None:
                columns[name], methods[name] = column, method

        fall_back("episode_id", next(iter(episode_attributes(names)), None), "positional_episode_attr")
        at = columns["episode_id"]
        fall_back("episode_time_sec", neighbour_attribute(names, at, 1), "positional_after_episode_id")
        fall_back(
            "pause_time_sec",
            neighbour_attribute(names, at, 2) or neighbour_attribute(names, columns["episode_time_sec"], 1),
            "positional_after_episode_time",
        )
        return cls(columns, methods)

    def with_guessed_weight(self, df: DataFrame) -> "FieldPlan":
        """Fill a missing weight column by looking at numbers, if one looks right."""
        if self.columns["weight_class"]:
            return self
        used = {self.columns[f] for f in ("sheet_name", "episode_id", "episode_time_sec", "pause_time_sec")}
        column = guess_weight_column(df, [c for c in df.columns if c not in used])
        if column is None:
            return self
        return replace(self, columns={**self.columns, "weight_class": column},
                       methods={**self.methods, "weight_class": "numeric_range"})


def weight_evidence(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per candidate column: how weight-like its numbers are."""
    value = F.col("value")
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), coerce.number_of(df, c).alias("value")) for c in columns
    ]))
    long = df.select(pairs.alias("p")).select("p.*")
    stats = long.groupBy("column_name").agg(
        F.count("value").alias("numbers"),
        F.avg(value.isNotNull().cast("double")).alias("numeric_share"),
        F.avg(value.between(35, 200).cast("double")).alias("in_range_share"),
        F.count_distinct(F.bround("value")).alias("distinct_values"),
    )
    return stats.withColumn(
        "weight_score",
        F.col("numeric_share") * 2.0 + F.col("in_range_share") - F.least(F.col("distinct_values") / 100.0, F.lit(0.5)),
    ).withColumn(
        "looks_like_weight",
        (F.col("numbers") > 0) & (F.col("distinct_values") > 1) & (F.col("in_range_share") >= 0.80)
        & (F.col("distinct_values") <= F.greatest(F.lit(20), F.floor(F.col("numbers") * 0.10))),
    )


def weight_candidates(names: list[str]) -> list[str]:
    return [
        n for n in names
        if n.startswith("metadata__") and any(w in n.strip().lower().replace("ё", "е") for w in lx.WEIGHT_WORDS)
    ]


def guess_weight_column(df: DataFrame, names: list[str]) -> str | None:
    candidates = weight_candidates(names)
    if not candidates:
        return None
    rows = weight_evidence(df, candidates).where("looks_like_weight").collect()  # one row per candidate column
    best = sorted(rows, key=lambda r: (-r["weight_score"], candidates.index(r["column_name"])))
    return best[0]["column_name"] if best else None


def is_total_row() -> Column:
    texts = F.array("athlete_name", "episode_id", "weight_class")
    return F.exists(texts, lambda t: F.coalesce(coerce.has_total_word(t), F.lit(False)))


def is_train_eligible() -> Column:
    return (
        ~F.col("is_total_row")
        & coerce.is_episode_id(F.col("episode_id"))
        & (F.col("observed_zap_class") != "unknown")
        & F.col("sequence_quality_flag").isin("high", "medium")
    )


def episode_fields(df: DataFrame, plan: FieldPlan, row: str = "source_row_index") -> DataFrame:
    """Project source columns to canonical fields, keeping row, codes and observation.

    `df` may already carry the observation columns and the engineered codes;
    absent ones get their defaults.
    """
    source = plan.columns

    def text(name: str) -> Column:
        return coerce.safe_text(F.col(f"`{source[name]}`") if source[name] else None)

    codes = {
        new: (F.coalesce(coerce.number_of(df, old), F.lit(0.0)) if old in df.columns else F.lit(0.0))
        for new, old in lx.CODE_NAMES.items()
    }
    defaults = {
        "observed_zap_class": F.lit("unknown"),
        "observed_zap_source_columns": F.array().cast("array<string>"),
        "observation_quality_flag": F.lit("unknown_missing_observation"),
        "observation_resolution_type": F.lit("unknown"),
        "observation_confidence_label": F.lit("low"),
        "mapping_version": F.lit("unknown"),
        "finish_match_classes": F.array().cast("array<string>"),
        "finish_match_columns": F.array().cast("array<string>"),
        "score_value": F.lit(None).cast("double"),
        "score_rounded": F.lit(None).cast("int"),
        "score_supported_class": F.lit(""),
    }
    seen = {n: (F.col(n) if n in df.columns else defaults[n]) for n in OBSERVATION_COLUMNS}
    fields = {
        **{n: text(n) for n in ("sheet_name", "athlete_name", "athlete_id")},
        **{n: text(n) for n in ("weight_class", "episode_id", "opponent_name", "tournament_name", "event_date")},
        **{n: coerce.number_or_zero(df, source[n]) for n in ("episode_time_sec", "pause_time_sec", "score")},
        "_explicit": text("explicit_sequence_id"),
    }
    rows = df.select(
        F.col(row).cast("long").alias("source_row_index"),
        *[c.alias(n) for n, c in {**fields, **codes, **seen}.items()],
    )
    surrogate = coerce.surrogate_athlete_id(F.col("athlete_name"), F.col("sheet_name"))
    return rows.withColumn("athlete_id", F.when(F.col("athlete_id") != "", F.col("athlete_id")).otherwise(surrogate))


def build_episodes(df: DataFrame, plan: FieldPlan, row: str = "source_row_index", block: int | None = None) -> DataFrame:
    """The canonical table. One shuffle on the context key, none for the row-wise parts."""
    rows = assign_sequences(episode_fields(df, plan, row), "_explicit", block=block)
    return (
        rows.withColumn("is_total_row", is_total_row())
        .withColumn("is_train_eligible", is_train_eligible())
        .withColumn("source_record_id", F.concat_ws("::", "sheet_name", "source_row_index"))
        .select(*lx.EPISODE_COLUMNS)
    )


def align(cleaned: DataFrame, *others: DataFrame, row: str = "source_row_index") -> DataFrame:
    """Put tables of the same rows side by side on the row id.

    All must have the same rows, each once: a row that one of them lacks or has twice
    raises while the result is made, so nothing is counted beforehand.
    """
    out = cleaned.withColumn("_has", F.lit(True))
    for other in others:
        clash = [c for c in other.columns if c in out.columns and c != row]
        out = out.join(other.drop(*clash).withColumn("_meets", F.lit(True)), row, "full_outer")
        out = out.withColumn("_has", F.col("_has") & F.col("_meets")).drop("_meets")
    if not others:
        return cleaned
    times = F.count(F.lit(1)).over(Window.partitionBy(row))  # dealt and sorted by the joins already
    same = F.coalesce(F.col("_has"), F.lit(False)) & (F.col("_times") == 1)
    checked = out.withColumn("_times", times).withColumn("_same", F.assert_true(same, F.lit("tables to align do not hold the same rows")))
    return checked.where(F.col("_same").isNull()).drop("_has", "_times", "_same")


def provenance(df_spark, plan: FieldPlan) -> DataFrame:
    """One row per logical field: source column, method, candidates."""
    rows = [(n, plan.columns[n], plan.methods[n], lx.FIELD_CANDIDATES[n]) for n in lx.FIELD_CANDIDATES]
    return df_spark.createDataFrame(
        rows, "field string, source_column string, selection_method string, candidates array<string>"
    )
