"""Model health, the recommendation ladder, report flags, and the run summary.

Inputs are short tables (states, moves) and one-row tables; conditions become
one-row columns, so that thresholds are visible in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..models.semantics import CONFIRMED, assignment_quality
from .profiles import dominant_by_coverage, dominant_by_posterior, dominant_confident
from .tables import beside, codes_where


def state_usage(df: DataFrame) -> DataFrame:
    counts = df.groupBy("hidden_state").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows") / counts.agg(F.sum("rows")).scalar())


def transition_health(counts: DataFrame) -> DataFrame:
    """Share of self moves, and the largest single self move."""
    own = F.col("from_state") == F.col("to_state")
    share = F.col("count") / F.col("_total")
    total = counts.withColumn("_total", counts.agg(F.sum("count")).scalar())
    return total.agg(
        F.coalesce(F.sum(F.when(own, share)), F.lit(0.0)).alias("self_transition_share"),
        F.coalesce(F.max(F.when(own, share)), F.lit(0.0)).alias("top_self_transition_share"),
    )


def model_health(df: DataFrame, counts: DataFrame, profile: DataFrame, observed: DataFrame, n_states: int,
                 assigned: dict[str, int], confidence: dict[str, float]) -> DataFrame:
    """One row. `counts` are transitions, `profile` the state profile, `observed`
    the shares of the observed layer."""
    quality, have, sure = assignment_quality(assigned, confidence)
    usage = state_usage(df).agg(
        F.sum("rows").alias("rows_total"),
        (F.count(F.when(F.col("share") >= 0.05, 1)) / F.lit(max(1, n_states))).alias("effective_state_usage"),
    )
    links = profile.agg(F.array_sort(F.collect_set("key_link")).alias("key_links"))
    rows = beside(usage, transition_health(counts), links, observed.select("direct_share", "no_score_rule_share"))
    low = (F.col("direct_share") < 0.05) & (F.col("no_score_rule_share") > 0.70)
    stuck = (F.col("self_transition_share") >= 0.95) | (F.col("effective_state_usage") <= 0.34)
    only = F.col("key_links") == F.array(F.lit("maneuvering"))

    def texts(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return rows.withColumns({
        "n_states": F.lit(n_states),
        "semantic_quality": F.lit(quality),
        "semantic_complete": F.lit(len(have) == len(lx.SEMANTIC_STATES)),
        "semantic_stable": F.lit(quality == "full"),
        "semantic_assigned": texts(have),
        "semantic_confirmed": texts(sure),
        "semantic_unconfirmed": texts([s for s in have if s not in sure]),
        "semantic_threshold": F.lit(CONFIRMED),
        "low_information_warning": low,
        "degenerate_transition_warning": stuck,
        "maneuvering_only_warning": only,
    }).withColumn("warnings", codes_where(
        low_information_observed_layer=low, degenerate_transitions=stuck, maneuvering_only_profile=only,
        semantics_partial=F.col("semantic_quality") == "partial", semantics_failed=F.col("semantic_quality") == "failed",
    )).drop("direct_share", "no_score_rule_share", "key_links")


def _label(state: Column, assigned: dict[str, int]) -> Column:
    out = F.lit("other")
    for block, name in reversed(lx.SEMANTIC_STATES):
        if name in assigned:
            out = F.when(state == assigned[name], F.lit(block)).otherwise(out)
    return out


def votes(df: DataFrame, assigned: dict[str, int]) -> DataFrame:
    """One row: the leading state by coverage, among sure rows, and by mean posterior."""
    tables = {"coverage": dominant_by_coverage(df), "confident": dominant_confident(df), "posterior": dominant_by_posterior(df)}
    named = [
        t.select(F.col("state").alias(f"{n}_state"), F.col("share").alias(f"{n}_share"),
                 _label(F.col("state"), assigned).alias(f"{n}_label"))
        for n, t in tables.items()
    ]
    return beside(*named)


def recommend(ballot: DataFrame, health: DataFrame, observed: DataFrame, sequence: DataFrame) -> DataFrame:
    """The recommendation profile and the reason for it, first match wins."""
    row = beside(
        ballot,
        health.select("rows_total", "self_transition_share", "semantic_quality", "degenerate_transition_warning", "maneuvering_only_warning"),
        observed.select("direct_share", "no_score_rule_share", "ambiguous_share", "unknown_share"),
        sequence.select("surrogate_sequence_share"),
    )
    cast = F.array("coverage_label", "confident_label", "posterior_label")
    blocks = [b for b, _ in lx.SEMANTIC_STATES]

    def votes_for(block: str) -> Column:
        return F.size(F.filter(cast, lambda v: v == block))

    counted = {b: votes_for(b) for b in blocks}
    row = row.withColumns({f"_n_{b}": c for b, c in counted.items()})
    most = F.greatest(*[F.col(f"_n_{b}") for b in blocks])
    # a tie goes to the vote cast first
    leader = F.coalesce(F.try_element_at(
        F.filter(cast, lambda v: F.coalesce(F.element_at(
            F.create_map(*[x for b in blocks for x in (F.lit(b), F.col(f"_n_{b}"))]), v) == most, F.lit(False))),
        F.lit(1)), F.lit("other"))
    row = row.withColumn("consensus", F.when(most > 0, leader).otherwise("other")).withColumn("consensus_votes", most)
    weak_data = (
        (F.col("direct_share") < 0.05) | (F.col("no_score_rule_share") > 0.70)
        | (F.col("ambiguous_share") + F.col("unknown_share") > 0.20) | (F.col("surrogate_sequence_share") > 0.80)
    )
    clear = (most >= 2) & (F.col("coverage_share") >= 0.40) & (F.col("posterior_share") >= 0.40)
    reason = (
        F.when(F.coalesce(F.col("rows_total"), F.lit(0)) == 0, "no_episodes")
        .when(F.col("semantic_quality") == "failed", "semantics_failed")
        .when(F.col("semantic_quality") == "partial", "semantics_partial")
        .when(F.col("maneuvering_only_warning"), "maneuvering_only")
        .when(F.col("degenerate_transition_warning"), "degenerate_transitions")
        .when(weak_data, "weak_data")
        .when(clear, F.concat(F.col("consensus"), F.lit("_dominates")))
        .when((F.col("coverage_share") < 0.40) & (F.col("posterior_share") < 0.40), "no_stable_state")
        .otherwise("mixed")
    )
    row = row.withColumn("reason", reason)
    cautious = ["semantics_failed", "semantics_partial", "maneuvering_only", "degenerate_transitions", "weak_data"]
    profile = (
        F.when(F.col("reason").isin("no_episodes", "no_stable_state"), "low-confidence profile")
        .when(F.col("reason").isin(cautious), "cautious profile")
        .when(F.col("reason").endswith("_dominates"), F.concat(F.col("consensus"), F.lit("-dominant")))
        .otherwise("mixed profile")
    )
    metrics = F.format_string(
        "coverage=%.2f, high_conf=%.2f, mean_posterior=%.2f, self_transition_share=%.2f",
        "coverage_share", "confident_share", "posterior_share", "self_transition_share",
    )
    return row.select(
        profile.alias("profile"), "reason", "consensus", "consensus_votes", "coverage_share", "confident_share",
        "posterior_share", metrics.alias("metrics"),
    )


def report_flags(observation: DataFrame, observed: DataFrame, sequence: DataFrame, health: DataFrame, metadata: DataFrame) -> DataFrame:
    """Report findings and next actions as (section, code) rows, in report order."""
    row = beside(
        observation.select("direct_finish_available", "unsupported_scores", "unsupported_finish_columns", "mapping_gap_detected"),
        observed.select("no_score_rule_share"), sequence.select("explicit_sequence_share", "surrogate_sequence_share"),
        health.select("semantic_quality", "degenerate_transition_warning", "maneuvering_only_warning"),
        metadata.select("episode_time_informative", "weight_class_informative"),
    )
    unmapped, gap = F.size("unsupported_finish_columns") > 0, F.col("mapping_gap_detected")
    unstable = F.col("semantic_quality").isin("partial", "failed")
    no_direct = ~F.col("direct_finish_available")
    bad_scores = F.size("unsupported_scores") > 0
    stuck = F.col("degenerate_transition_warning")
    findings = codes_where(
        no_direct_finish=no_direct, mostly_no_score=F.col("no_score_rule_share") >= 0.70, unsupported_scores=bad_scores,
        unmapped_finish_columns=unmapped, mapping_gap=gap,
        surrogate_segmentation=(F.col("explicit_sequence_share") <= 0.01) & (F.col("surrogate_sequence_share") >= 0.90),
        semantics_unstable=unstable, degenerate_transitions=stuck, maneuvering_only_states=F.col("maneuvering_only_warning"),
    )
    actions = codes_where(
        add_direct_finish_columns=no_direct, extend_mapping_rules=unmapped, review_mapping=gap & ~unmapped,
        add_score_rules=bad_scores, confirm_episode_time=~F.col("episode_time_informative"),
        confirm_weight_class=~F.col("weight_class_informative"), add_sequence_marker=F.col("explicit_sequence_share") <= 0.01,
        enrich_observed_layer=stuck, repeat_semantic_assignment=unstable,
    )
    marked = F.flatten(F.array(
        F.transform(findings, lambda c, i: F.struct(F.lit("finding").alias("section"), (i + 1).alias("place"), c.alias("code"))),
        F.transform(actions, lambda c, i: F.struct(F.lit("next_action").alias("section"), (i + 1).alias("place"), c.alias("code"))),
    ))
    return row.select(F.explode(marked).alias("f")).select("f.*")


def run_summary(df: DataFrame, *parts: DataFrame) -> DataFrame:
    """Row, training and sequence counts beside the given one-row summaries."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows_total"), F.count(F.when(F.col("is_train_eligible"), 1)).alias("rows_train_eligible"),
        F.first("mapping_version").alias("mapping_version"),
    )
    sequences = df.select("sequence_id").distinct().agg(F.count(F.lit(1)).alias("n_sequences"))
    taken = set(counts.columns) | {"n_sequences"}
    kept = []
    for part in parts:
        kept.append(part.select(*[c for c in part.columns if c not in taken]))
        taken |= set(part.columns)
    return beside(counts, sequences, *kept)
