"""Mixing sources to target weights by capped water-filling.

Sources share a budget in proportion to their weights. A source whose share is
above `max_epochs` times its size is clamped there, and what it gives up is dealt
again to the others by weight, until no share is above its cap. That fixed point
is found in one ordered scan: sources sorted by cap / weight are clamped one after
the other as long as the level (rest of the budget / rest of the weight) is above
that ratio; those behind take level * weight.

A source then repeats `floor(target / size)` times as a whole and takes the rest
from a seeded order of its documents: all up to the one at which the rest is
reached, and that one too if this comes nearer. Places in that order are found in
buckets of the order's hash, with running sums over buckets and then inside them,
so no task sorts a source whole.

Defined results: null text has size 0; a null source is a source of its own, last
in order; sources of size 0 have target 0; documents of size 0 take 0; null and
repeated ids stay as rows; an empty table gives no rows. Columns not named by
`keep` are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.session import park

from .text import words

#: Buckets of a source's seeded order grow with the table, at this many rows each on average over all sources.
BUCKET_ROWS = 4096
#: Decimals to which targets are rounded, so that engines agree on them.
DIGITS = 6


def seeded(key: Column, seed: int) -> Column:
    """60-bit order of a document: first hex digits of an MD5 sum."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, share: Column, max_epochs: Column) -> DataFrame:
    """`target` for rows with `source`, `source_size`, `weight`; other columns stay.

    One row per source; the scan over sources is one ordered window of that table.
    `share` is the budget as a part of all sizes.
    """
    everything = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    so_far = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    table = sizes.withColumn("cap", max_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    table = (
        table.withColumn("budget", share * F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(so_far), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(so_far), F.lit(0.0)))
        .withColumn("level_here", (F.col("budget") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
        .withColumn("clamped", F.col("ratio") <= F.col("level_here"))
    )
    level = F.max(F.when(~F.col("clamped"), F.col("level_here"))).over(everything)
    return table.withColumn(
        "target", F.round(F.when(F.col("clamped"), F.col("cap")).otherwise(F.least("cap", level * F.col("weight"))), DIGITS)
    ).drop("cap", "ratio", "budget", "weights", "cap_before", "weight_before", "level_here", "clamped", "weight")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 8,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: bool = False,
) -> DataFrame:
    """`doc_id`, `size`, `source`, `source_size`, `target`, `times`, `taken` of every document.

    Weights repeat over the sources in code-point order, null last. With `carry`, the
    document itself comes along as a struct `row`.
    """
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    rows = docs.select(
        F.col(key).alias("doc_id"), F.size(words(F.col(text))).cast("bigint").alias("size"), F.col(source).alias("source"), *row
    ).withColumn("at", seeded(F.col("doc_id"), seed))
    summed = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    summed = summed.withColumn("sid", place)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    goal = targets(summed.withColumn("weight", weight), F.lit(share), F.lit(max_epochs))
    goal = (
        goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(float(BUCKET_ROWS)))).cast("bigint"))
        .withColumnRenamed("source", "goal_source")
    )
    goal = park(goal, "mixing")  # a row per source; written, so that Spark knows its size when it picks the join
    # the hash's range is cut evenly, so buckets follow each other in the seeded order
    placed = rows.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).withColumn("bucket", F.expr(f"at div ({1 << 60} div buckets + 1)"))
    by_bucket = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    before = by_bucket.select("sid", "bucket", (F.sum("n").over(W.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = W.partitionBy("sid", "bucket").orderBy("at", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ordered = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    begin = F.col("before") + F.col("inside")
    times = F.col("whole") + F.when(begin + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)
    return (
        ordered.join(before, ["sid", "bucket"])
        .withColumn("times", F.when(F.col("size") > 0, times).otherwise(0).cast("bigint"))
        .select("doc_id", "size", "source", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), *(["row"] if carry else []))
    )


def repeat(docs: DataFrame, **mixing) -> DataFrame:
    """The documents with their own columns, each as many times as `mix` takes it."""
    taken = mix(docs, carry=True, **mixing).where(F.col("times") > 0)
    again = taken.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    return again.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
