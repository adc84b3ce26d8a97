"""Observed class per episode from finish signals, with the score as fallback."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce, lexicon as lx
from ..functions.names import find_column

OBSERVATION_COLUMNS = [
    "observed_zap_class", "observed_zap_source_columns", "observation_quality_flag",
    "observation_resolution_type", "observation_confidence_label", "mapping_version",
    "finish_match_classes", "finish_match_columns", "score_value", "score_rounded", "score_supported_class",
]


@dataclass(frozen=True)
class ObservationRules:
    version: str = lx.MAPPING_VERSION
    score_columns: list[str] = field(default_factory=lambda: list(lx.SCORE_COLUMNS))
    score_classes: dict[int, str] = field(default_factory=lambda: dict(lx.SCORE_CLASSES))
    position_classes: dict[int, str] = field(default_factory=lambda: dict(lx.POSITION_CLASSES))
    any_words: dict[str, list[str]] = field(default_factory=lambda: dict(lx.FINISH_ANY))
    all_words: dict[str, list[str]] = field(default_factory=lambda: dict(lx.FINISH_ALL))

    @classmethod
    def from_json(cls, path: str) -> "ObservationRules":
        """Rules file: version, score columns, score and position classes, finish rules."""
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        rules = raw.get("finish_rules") or []
        low = {
            kind: {r.get("class_name", "unknown"): [w.lower() for w in r[kind]] for r in rules if r.get(kind)}
            for kind in ("match_any_tokens", "match_all_tokens")
        }
        return cls(
            version=str(raw.get("version", "observation_mapping_v1")),
            score_columns=list(raw.get("score_column_candidates") or []),
            score_classes={int(k): str(v) for k, v in (raw.get("score_to_class") or {}).items()},
            position_classes={int(k): str(v) for k, v in (raw.get("finish_position_to_class") or {}).items()},
            any_words=low["match_any_tokens"],
            all_words=low["match_all_tokens"],
        )

    @property
    def classes(self) -> list[str]:
        return sorted({*self.any_words, *self.all_words})


# quality, resolution and confidence of each case of the decision, in order
VERDICTS = [
    ("unknown_ambiguous_finish", "ambiguous", "low"),
    ("ok_finish_rule", "direct_finish_signal", "high"),
    ("ok_finish_rule_score_mismatch", "direct_finish_signal", "high"),
    ("unknown_missing_score_and_finish", "unknown", "low"),
    ("ok_no_score_rule", "no_score_rule", "high"),
    ("unknown_unsupported_score", "unknown", "low"),
    ("ok_score_rule", "inferred_from_score", "medium"),
]


def column_words(text: str) -> str:
    return text.strip().lower().replace("ё", "е")


def finish_position(text: str) -> int | None:
    low = column_words(text)
    hits = (re.search(p, low) for p in lx.POSITION_PATTERNS)
    return next((int(h.group(1)) for h in hits if h), None)


def mapped_classes(text: str, rules: ObservationRules) -> list[str]:
    """Classes a column stands for, by its words or by the number in its name."""
    low = column_words(text)
    named = {
        cls for cls in rules.classes
        if any(w in low for w in rules.any_words.get(cls, []))
        or (rules.all_words.get(cls) and all(w in low for w in rules.all_words[cls]))
    }
    by_place = rules.position_classes.get(finish_position(text) or 0)
    if by_place in rules.classes:
        named.add(by_place)
    return sorted(named)


def finish_columns(names: list[str], rules: ObservationRules, labels: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Column → classes, for every column that can signal a finish.

    `labels` gives other text to match on, for example the source header.
    """
    labels = labels or {}
    found = {n: mapped_classes(labels.get(n, n), rules) for n in names}
    return {n: classes for n, classes in found.items() if classes}


def finish_like_columns(names: list[str]) -> list[str]:
    return sorted({n for n in names if any(w in column_words(n) for w in lx.FINISH_LIKE)})


def _texts(values: list[Column]) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*values))))


def _class_of_score(rounded: Column, rules: ObservationRules) -> Column:
    out = F.lit(None).cast("string")
    for value, cls in rules.score_classes.items():
        out = F.when(rounded == value, F.lit(cls)).otherwise(out)
    return out


def observe(
    df: DataFrame,
    rules: ObservationRules | None = None,
    names: list[str] | None = None,
    labels: dict[str, str] | None = None,
) -> DataFrame:
    """Append the eleven observation columns. A projection: no shuffle, no UDF.

    Decision, first match wins: several finish classes, one finish class, no
    score, zero score, unsupported score, mapped score.
    """
    rules = rules or ObservationRules()
    names = names or df.columns
    signals = finish_columns(names, rules, labels)
    score_column = find_column(names, rules.score_columns)

    value = coerce.score(F.col(f"`{score_column}`")) if score_column else F.lit(None).cast("double")
    work = df.withColumns({**{f"_on_{n}": coerce.is_positive(F.col(f"`{n}`")) for n in signals}, "score_value": value})
    on = {n: F.col(f"`_on_{n}`") for n in signals}
    work = work.withColumns({
        "finish_match_classes": _texts([F.when(on[n], F.lit(c)) for n, many in signals.items() for c in many]),
        "finish_match_columns": _texts([F.when(on[n], F.lit(n)) for n in signals]),
        "score_rounded": F.bround("score_value").try_cast("int"),
    }).drop(*[f"_on_{n}" for n in signals])
    work = work.withColumns({
        "score_supported_class": F.coalesce(_class_of_score(F.col("score_rounded"), rules), F.lit("")),
        "_hits": F.size("finish_match_classes"),
        "_direct": F.try_element_at("finish_match_classes", F.lit(1)),
    })
    by_score, direct, hits = F.col("score_supported_class"), F.col("_direct"), F.col("_hits")
    case = (
        F.when(hits > 1, 1)
        .when((hits == 1) & by_score.isin(F.lit(""), direct), 2)
        .when(hits == 1, 3)
        .when(F.col("score_value").isNull(), 4)
        .when(F.abs("score_value") < 1e-12, 5)
        .when(by_score == "", 6)
        .otherwise(7)
    )
    sources = F.col("finish_match_columns")
    if score_column:
        sources = F.array_sort(F.array_union(sources, F.array(F.lit(score_column))))
    at = F.col("_case")
    picked = F.when(at.isin(2, 3), direct).when(at == 5, "no_score").when(at == 7, by_score).otherwise("unknown")

    def label(place: int) -> Column:
        return F.element_at(F.array(*[F.lit(verdict[place]) for verdict in VERDICTS]), at)

    return work.withColumn("_case", case).withColumns({
        "observed_zap_class": coerce.clamp(picked, lx.OBSERVED_CLASSES, "unknown"),
        "observed_zap_source_columns": sources,
        "observation_quality_flag": label(0),
        "observation_resolution_type": label(1),
        "observation_confidence_label": label(2),
        "mapping_version": F.lit(rules.version),
    }).drop("_case", "_hits", "_direct")
