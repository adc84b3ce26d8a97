"""State and row profiles: averages, dominant blocks, shares, votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce, lexicon as lx
from .features import row_signal
from .transitions import state_name

GRIPS = ["kfv_capture_code", "kfv_grip_code", "kfv_wrap_code", "kfv_hook_code", "kfv_post_code"]
PROFILE_MEASURES = list(lx.CODE_NAMES) + ["score", "confidence"]
DIRECTIONS = ["maneuvering", "kfv", "vup"]


def with_row_signals(df: DataFrame) -> DataFrame:
    return df.withColumns({
        f"{block}_signal": row_signal([c for c in cols if c in df.columns]) for block, cols in lx.BLOCK_FEATURES.items()
    })


def _added(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])


def first_largest(scores: dict[str, Column]) -> Column:
    """Name of the largest score; the first one wins a tie."""
    top = F.greatest(*scores.values())
    names = list(scores)
    out = F.lit(names[-1])
    for name in reversed(names[:-1]):
        out = F.when(scores[name] == top, F.lit(name)).otherwise(out)
    return out


def dominant_link() -> Column:
    return first_largest({
        "maneuvering": _added(["maneuver_right_code", "maneuver_left_code"]), "kfv": _added(GRIPS), "vup": F.col("vup_code"),
    })


def state_profile(df: DataFrame) -> DataFrame:
    """Averages of the ten measures per state, row count, name and dominant block."""
    means = [F.avg(c).alias(c) for c in PROFILE_MEASURES if c in df.columns]
    name = F.min("hidden_state_name") if "hidden_state_name" in df.columns else F.min(state_name({}, F.col("hidden_state")))
    out = df.groupBy("hidden_state").agg(*means, F.count(F.lit(1)).alias("episodes_count"), name.alias("hidden_state_name"))
    return out.withColumn("key_link", dominant_link())


def feature_profile(df: DataFrame, features: list[str], names: dict[int, str] | None = None) -> DataFrame:
    """Averages of the given features per state."""
    out = df.groupBy("hidden_state").agg(*[F.avg(c).alias(c) for c in features], F.count(F.lit(1)).alias("episodes_count"))
    return out.withColumn("hidden_state_name", state_name(names or {}, F.col("hidden_state")))


def interpret_states(profile: DataFrame, semantic: dict[str, int], confidence: dict[str, float]) -> DataFrame:
    """Post-hoc label by the largest of four blocks, plus the semantic label if any."""
    by_state = {v: k for k, v in semantic.items()}
    label = first_largest({
        "maneuvering": F.col("maneuver_right_code") + F.col("maneuver_left_code"), "kfv": F.col("kfv_code"),
        "vup": F.col("vup_code"), "outcome_actions": F.col("outcome_actions_code"),
    })
    given, trust = F.lit(""), F.lit(0.0)
    for state, name in by_state.items():
        given = F.when(F.col("hidden_state") == state, F.lit(name)).otherwise(given)
        trust = F.when(F.col("hidden_state") == state, F.lit(float(confidence.get(name, 0.0)))).otherwise(trust)
    return profile.withColumns({"posthoc_block": label, "semantic_label": given, "semantic_confidence": trust})


def summary_lines(profile: DataFrame) -> DataFrame:
    """One line of text per state."""
    two = [F.coalesce(F.col(c), F.lit(0.0)) for c in
           ("maneuver_right_code", "maneuver_left_code", "kfv_code", "vup_code", "observed_result")]
    return profile.select("hidden_state", F.format_string(
        "Latent state %s: n=%d, maneuverR=%.2f, maneuverL=%.2f, KFV=%.2f, VUP=%.2f, result=%.2f",
        F.col("hidden_state_name"), F.col("episodes_count"), *two,
    ).alias("line"))


def observed_layer(df: DataFrame) -> DataFrame:
    """One row: shares of the five resolutions and the three confidences."""
    how, trust = F.col("observation_resolution_type"), F.col("observation_confidence_label")
    return df.agg(
        coerce.share(how == "direct_finish_signal").alias("direct_share"),
        coerce.share(how == "inferred_from_score").alias("inferred_from_score_share"),
        coerce.share(how == "no_score_rule").alias("no_score_rule_share"),
        coerce.share(how == "ambiguous").alias("ambiguous_share"),
        coerce.share(how == "unknown").alias("unknown_share"),
        *[coerce.share(trust == label).alias(f"{label}_conf_share") for label in lx.CONFIDENCE_LABELS],
    )


def sequence_quality(df: DataFrame) -> DataFrame:
    """One row: shares of three qualities and three ways of finding the sequence."""
    return df.agg(
        *[coerce.share(F.col("sequence_quality_flag") == q).alias(f"{q}_quality_share") for q in ("high", "medium", "low")],
        *[coerce.share(F.col("sequence_resolution_type") == r).alias(f"{r}_sequence_share")
          for r in ("explicit", "surrogate", "fallback")],
    )


def dominant_by_coverage(df: DataFrame, row: str = "source_row_index") -> DataFrame:
    """The most frequent state and its share; the one seen first wins a tie."""
    per = df.groupBy("hidden_state").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first"))
    return per.agg(
        F.coalesce(F.max_by("hidden_state", F.struct("n", -F.col("first"))), F.lit(-1)).alias("state"),
        F.coalesce(F.max("n") / F.sum("n"), F.lit(0.0)).alias("share"),
    )


def dominant_confident(df: DataFrame, threshold: float = 0.70, row: str = "source_row_index") -> DataFrame:
    return dominant_by_coverage(df.where(F.col("confidence") >= threshold), row)


def probability_columns(df: DataFrame) -> list[str]:
    cols = [c for c in df.columns if c.startswith("p_state_") and c[8:].isdigit()]
    return sorted(cols, key=lambda c: int(c[8:]))


def dominant_by_posterior(df: DataFrame) -> DataFrame:
    """The state with the largest average posterior."""
    cols = probability_columns(df)
    means = df.agg(F.array(*[F.avg(c) for c in cols]).alias("m"))
    at = (F.array_position("m", F.array_max("m")) - 1).cast("int")
    return means.select(
        F.coalesce(F.element_at(F.array(*[F.lit(int(c[8:])) for c in cols]), at + 1), F.lit(-1)).alias("state"),
        F.coalesce(F.array_max("m"), F.lit(0.0)).alias("share"),
    )
