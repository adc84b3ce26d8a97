"""Engineered features: indicator columns packed into codes, plus model inputs."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, lexicon as lx
from ..functions.names import ColumnName, HeaderDictionary, columns_with, find_column


# --- encoders ------------------------------------------------------------------

def bitpack(flags: list[Column]) -> Column:
    """Σ flag·2^i as bigint."""
    if len(flags) > 62:
        raise ValueError(f"{len(flags)} indicator columns do not fit one 64-bit code")
    shifted = [F.shiftleft(f.cast("long"), i) for i, f in enumerate(flags)]
    return reduce(lambda a, b: a + b, shifted, F.lit(0).cast("long"))


def log_of_mask(mask: Column) -> Column:
    """log2(mask + 1); zero for an empty mask."""
    return F.log2(mask.cast("double") + 1.0)


def encode(flags: list[Column], mode: str) -> Column:
    if mode not in ("bitpack", "log_bitpack", "count", "sum", "any"):
        raise ValueError(f"unknown encoding {mode!r}")
    if not flags:
        return F.lit(0.0)
    if mode == "bitpack":
        return bitpack(flags).cast("double")
    if mode == "log_bitpack":
        return log_of_mask(bitpack(flags))
    if mode == "any":
        return F.greatest(*flags, F.lit(0)).cast("double")
    return reduce(lambda a, b: a + b, flags).cast("double")


def grip_parts(kfv: list[str], ranges: dict[str, tuple[int, int]]) -> dict[str, list[str]]:
    """Contact columns of each part.

    A column that names its part (as matrix sheets do) belongs there. The others go by
    their closing number, or without one (or with 0) by their place among all, numbered
    columns first.
    """
    columns = sorted(map(ColumnName.read, kfv), key=lambda c: (not c.index, c.index or 0, c.name))
    named = {c.name: part for c in columns for part in ranges if f"__{part}_" in c.name}
    spans = [(part, range(first, last + 1)) for part, (first, last) in ranges.items()]
    placed = {c.name: next((part for part, span in spans if (c.index or place) in span), None) for place, c in enumerate(columns, start=1)}
    return {part: [c.name for c in columns if named.get(c.name, placed[c.name]) == part] for part in ranges}


# --- which columns feed which feature -------------------------------------------

@dataclass(frozen=True)
class FeaturePlan:
    """Column choices made from names alone; inspect it to see why a code is zero."""

    groups: dict[str, list[str]]
    inputs: dict[str, list[str]]
    fields: dict[str, str | None]
    encoders: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_names(cls, names: list[str], dictionary: HeaderDictionary | None = None,
                   encoders: dict[str, str] | None = None, grip_ranges: dict | None = None) -> "FeaturePlan":
        dictionary = dictionary or HeaderDictionary()

        def group(block: str) -> list[str]:
            return dictionary.columns_of(names, block) or columns_with(names, lx.GROUP_WORDS[block])

        right = columns_with(names, lx.MANEUVER_RIGHT_WORDS)
        left = columns_with(names, lx.MANEUVER_LEFT_WORDS)
        if not right and not left:
            stances = group("maneuvering")
            middle = len(stances) // 2
            right, left = (stances[:middle], stances[middle:]) if middle else (stances, [])

        kfv = group("kfv")
        outcomes = group("outcomes")
        inputs = {
            "maneuver_right_code": right,
            "maneuver_left_code": left,
            **{f"{part}_code": cols for part, cols in grip_parts(kfv, grip_ranges or lx.GRIP_RANGES).items()},
            "kfv_code": kfv,
            "vup_code": group("vup"),
            "outcome_actions_code": [n for n in outcomes if "score" not in n.lower() and "балл" not in n.lower()],
        }
        fields = {
            "duration": find_column(names, lx.FEATURE_DURATION),
            "pause": find_column(names, lx.FEATURE_PAUSE),
            "observed_result": find_column(names, lx.FEATURE_RESULT),
            "episode": find_column(names, lx.FEATURE_EPISODE),
            "athlete": find_column(names, lx.CLEAN_ATHLETE),
            "sheet": find_column(names, lx.CLEAN_SHEET),
        }
        groups = {"maneuvering": sorted({*right, *left}), "kfv": kfv, "vup": inputs["vup_code"], "outcomes": outcomes}
        return cls(groups, inputs, fields, dict(encoders or {}))

    def missing_groups(self) -> list[str]:
        return [g for g in lx.FEATURE_GROUPS if not self.groups[g]]

    def trace_rows(self) -> list[tuple[str, str, list[str], str, int]]:
        """(feature, encoding, source columns, source group, source count)."""
        rows = [
            (name, self.encoders.get(name, "log_bitpack"), cols, name.removesuffix("_code"), len(cols))
            for name, cols in self.inputs.items()
        ]
        for name, group in (("duration", "metadata"), ("pause", "metadata"), ("observed_result", "outcomes")):
            cols = [self.fields[name]] if self.fields[name] else []
            rows.append((name, "numeric_passthrough", cols, group, len(cols)))
        return rows

    def raw_columns(self) -> list[str]:
        return sorted({c for cols in self.groups.values() for c in cols} | {c for c in self.fields.values() if c})


def traceability(spark: SparkSession, plan: FeaturePlan) -> DataFrame:
    return spark.createDataFrame(
        plan.trace_rows(),
        "engineered_feature string, encoding_mode string, source_columns array<string>, source_group string, source_count int",
    )


def validation(spark: SparkSession, plan: FeaturePlan) -> DataFrame:
    missing = plan.missing_groups()
    warnings = [f"no {g} columns found; their features are zero" for g in missing]
    return spark.createDataFrame(
        [(not missing, missing, warnings)], "is_valid boolean, missing_groups array<string>, warnings array<string>"
    )


def signal_source(plan: FeaturePlan) -> dict[str, object]:
    """Where the observed result comes from: a direct outcome column or a proxy score."""
    outcomes = sorted(n for n in plan.raw_columns() if n.lower().startswith("outcomes__"))
    direct = [n for n in outcomes if "zap" in n.lower()]
    source = direct or ([plan.fields["observed_result"]] if plan.fields["observed_result"] else [])
    return {
        "signal_column": direct[0] if direct else "observed_result",
        "classification": "direct_zap" if direct else "proxy",
        "source_columns": source,
        "available_outcome_columns": outcomes,
    }


# --- the operators ----------------------------------------------------------------

def engineer(df: DataFrame, plan: FeaturePlan | None = None) -> DataFrame:
    """Append the thirteen engineered features in one projection."""
    plan = plan or FeaturePlan.from_names(df.columns)
    sources = sorted({c for cols in plan.inputs.values() for c in cols})
    codes = {
        name: encode([F.col(f"`_bit_{c}`") for c in cols], plan.encoders.get(name, "log_bitpack"))
        for name, cols in plan.inputs.items()
    }
    numbers = {n: coerce.number_or_zero(df, plan.fields[n]) for n in ("duration", "pause", "observed_result")}
    bits = df.withColumns({f"_bit_{c}": coerce.indicator_flag_of(df, c) for c in sources})
    return bits.withColumns({**codes, **numbers}).drop(*[f"_bit_{c}" for c in sources])


def research_sequence_id(athlete: Column | None, sheet: Column | None, episode: Column | None) -> Column:
    """Sheet+athlete, athlete+episode, athlete, sheet+episode, sheet, episode, else the default."""
    a, s, e = (coerce.safe_text(x) for x in (athlete, sheet, episode))
    mark = F.lit("::")
    return (
        F.when((s != "") & (a != ""), F.concat(s, mark, a))
        .when((a != "") & (e != ""), F.concat(a, mark, e))
        .when(a != "", a)
        .when((s != "") & (e != ""), F.concat(s, mark, e))
        .when(s != "", s)
        .when(e != "", e)
        .otherwise(F.lit(lx.DEFAULT_SEQUENCE))
    )


def with_research_keys(df: DataFrame, plan: FeaturePlan, row: str) -> DataFrame:
    """Append episode id, athlete, sheet and sequence id for the research cycle."""
    col = {k: (F.col(f"`{v}`") if v else None) for k, v in plan.fields.items()}
    out = df.withColumn(
        "episode_id", F.coalesce(col["episode"].cast("string"), F.lit("")) if col["episode"] is not None
        else F.col(row).cast("string"),
    )
    for name, source in (("athlete_name", "athlete"), ("source_sheet", "sheet")):
        if col[source] is not None:
            out = out.withColumn(name, F.coalesce(col[source].cast("string"), F.lit("")))
    return out.withColumn("sequence_id", research_sequence_id(col["athlete"], col["sheet"], col["episode"]))


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.var_pop(F.coalesce(coerce.number_of(df, c), F.lit(0.0))).alias(c) for c in columns])


def model_inputs(df: DataFrame) -> tuple[list[str], list[str]]:
    """Columns fit for the model, and the constant ones left out. One aggregate job.

    Outcome, result and score columns never enter. If all are constant, all stay.
    """
    ordered = [c for c in lx.MODEL_FEATURES if c in df.columns] or df.columns
    ordered = [c for c in ordered if not any(w in c.lower() for w in ("outcome", "result", "score"))]
    spread = variances(df, ordered).first()
    kept = [c for c in ordered if (spread[c] or 0.0) > 1e-12]
    return (kept, [c for c in ordered if c not in kept]) if kept else (ordered, [])


def hidden_layer(df: DataFrame, keep: list[str]) -> DataFrame:
    """Ten feature columns (0 when absent) and the observed class (default unknown)."""
    layer = [
        (F.coalesce(coerce.number_of(df, c), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c)
        for c in lx.HIDDEN_LAYER
    ]
    seen = F.coalesce(F.col("observed_zap_class"), F.lit("unknown")) if "observed_zap_class" in df.columns else F.lit("unknown")
    return df.select(*keep, *layer, seen.alias("observed_zap_class"))


def semantic_view(df: DataFrame) -> DataFrame:
    """Add feature names used to name states; kfv is the sum of the five grip codes."""
    parts = ["kfv_capture_code", "kfv_grip_code", "kfv_wrap_code", "kfv_hook_code", "kfv_post_code"]
    return df.withColumns({
        **{old: F.col(new) for new, old in lx.CODE_NAMES.items()},
        "kfv_code": reduce(lambda a, b: a + b, [F.col(p) for p in parts]),
        "duration": F.col("episode_time_sec"),
        "pause": F.col("pause_time_sec"),
    })


# --- scaling -----------------------------------------------------------------------

@dataclass(frozen=True)
class Scaler:
    """Population mean and deviation per column, and a weight after scaling."""

    columns: list[str]
    means: list[float]
    deviations: list[float]
    weights: list[float]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], weights: list[float] | None = None) -> "Scaler":
        stats = df.agg(
            *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)],
        ).first()
        spread = [float(stats[f"s_{i}"] or 0.0) for i in range(len(columns))]
        return cls(
            list(columns), [float(stats[f"m_{i}"] or 0.0) for i in range(len(columns))],
            [s if s > 0 else 1.0 for s in spread], list(weights or [1.0] * len(columns)),
        )

    def missing_from(self, df: DataFrame) -> list[str]:
        return [c for c in self.columns if c not in df.columns]

    def vector(self, name: str = "x") -> Column:
        return F.array(*[self.scaled(i) for i in range(len(self.columns))]).alias(name)

    def scaled(self, i: int) -> Column:
        return (F.col(self.columns[i]) - F.lit(self.means[i])) / F.lit(self.deviations[i]) * F.lit(self.weights[i])


def block_of_feature(name: str) -> str:
    for block, columns in lx.BLOCK_FEATURES.items():
        if name in columns:
            return block
    return "temporal" if name in ("duration", "pause") else "other"


def block_weights(columns: list[str], weights: dict[str, float] | None = None) -> list[float]:
    """Block weight divided by the root of the block's column count."""
    weights = weights or lx.BLOCK_WEIGHTS
    blocks = [block_of_feature(c) for c in columns]
    return [weights.get(b, 1.0) / blocks.count(b) ** 0.5 for b in blocks]


def row_signal(columns: list[str]) -> Column:
    """Mean of absolute values over a block's columns."""
    if not columns:
        return F.lit(0.0)
    return reduce(lambda a, b: a + b, [F.abs(F.coalesce(F.col(c), F.lit(0.0))) for c in columns]) / len(columns)


