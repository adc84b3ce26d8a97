"""Runs cut into bounded segments: the input of training and decoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import Ordering
from ..operators.sequences import number_runs
from ..session import park

SEGMENT = 8192


@dataclass(frozen=True)
class Segments:
    """`table` has the run keys, `seg`, `rows`, `x`, `opens`, `closes`, `mult`.

    `x` holds class numbers, or feature vectors laid end to end. Most runs fit
    one segment (`whole`); `parts` are the pieces of longer runs.
    """

    table: DataFrame
    keys: tuple[str, ...]
    last_seg: int

    @property
    def has_parts(self) -> bool:
        return self.last_seg > 0

    @property
    def whole(self) -> DataFrame:
        return self.table.where(F.col("opens") & F.col("closes"))

    @property
    def parts(self) -> DataFrame:
        return self.table.where(~(F.col("opens") & F.col("closes")))

    def release(self) -> None:
        self.table.unpersist()


def cut_runs(
    df: DataFrame, order: Ordering, value: Column, sequence: str = "sequence_id", length: int = SEGMENT,
    vector: bool = False,
) -> DataFrame:
    """Group rows into segments of at most `length` rows, in row order.

    Runs are numbered on the rows given, so filter training rows before.
    """
    runs = number_runs(df.withColumn("_x", value), order, sequence)
    seg = F.floor(F.col("_at") / F.lit(length)).cast("long")
    cells = F.array_sort(F.collect_list(F.struct(F.col(order.row).alias("row"), F.col("_x").alias("x"))))
    grouped = runs.withColumn("seg", seg).groupBy(*order.keys, "run_no", "seg").agg(
        cells.alias("_cells"),  # at most `length` rows
        F.max("_opens").alias("opens"), F.max("_closes").alias("closes"),
    )
    x = F.transform("_cells", lambda c: c["x"])
    return grouped.select(
        *order.keys, "run_no", "seg", F.transform("_cells", lambda c: c["row"]).alias("rows"),
        (F.flatten(x) if vector else x).alias("x"), "opens", "closes", F.lit(1.0).alias("mult"),
    )


def collapse(cut: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Replace equal whole runs by one with a multiplicity.

    Expected counts add up, so training on the result is the same work in fewer
    rows. Only for class numbers, and only for training: row ids are dropped.
    """
    whole = F.col("opens") & F.col("closes")
    one = cut.where(whole).groupBy("x").agg(F.sum("mult").alias("mult"), *[F.min(k).alias(k) for k in (*keys, "seg")])
    one = one.withColumn("rows", F.array().cast("array<bigint>")).withColumn("opens", F.lit(True)).withColumn("closes", F.lit(True))
    return one.select(*cut.columns).unionByName(cut.where(~whole))


def hold(cut: DataFrame, keys: tuple[str, ...], passes: bool = True) -> Segments:
    """Write the segments once; keep them in memory too when many passes follow.

    A lost executor re-reads its part of the table; nothing is computed again.
    """
    table = park(cut, "segments")
    if passes:
        table = table.persist(StorageLevel.MEMORY_AND_DISK)
    inner = table.where(~(F.col("opens") & F.col("closes"))).agg(F.max("seg")).first()[0]
    return Segments(table, (*keys, "run_no"), int(inner or 0))


def both(df: DataFrame, order: Ordering, value: Column, sequence: str = "sequence_id", length: int = SEGMENT) -> tuple[Segments, Segments]:
    """Segments to train on, equal runs collapsed, and those to decode, of the same rows, which are cut once.

    Call `release` on the first when the training is done.
    """
    cut = park(cut_runs(df, order, value, sequence, length), "cut")
    held = hold(collapse(cut, (*order.keys, "run_no")), order.keys)
    return held, Segments(cut, held.keys, held.last_seg)


def segments(
    df: DataFrame, order: Ordering, value: Column, sequence: str = "sequence_id", length: int = SEGMENT,
    vector: bool = False, distinct: bool = False, passes: bool = True,
) -> Segments:
    """Segments of the rows given. Call `release` when a table held in memory is done with."""
    cut = cut_runs(df, order, value, sequence, length, vector)
    if distinct:
        cut = collapse(park(cut, "cut"), (*order.keys, "run_no"))
    return hold(cut, order.keys, passes)
