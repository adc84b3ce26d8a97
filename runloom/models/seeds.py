"""First means of a Gaussian model: rows where one block of features stands out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators.features import Scaler, row_signal
from ..operators.ordered import Ordering, with_place
from ..operators.selection import mean_of_top, nth_largest


def dominance(df: DataFrame, block: str) -> Column:
    """A block's row signal minus the largest of the other blocks; null unless positive."""
    signal = {b: row_signal([c for c in cols if c in df.columns]) for b, cols in lx.BLOCK_FEATURES.items()}
    gap = signal[block] - F.greatest(*[s for b, s in signal.items() if b != block])
    return F.when(gap > 0, gap)


def seed_means(df: DataFrame, scaler: Scaler, n_states: int, row: str) -> tuple[np.ndarray, int]:
    """Mean vector per state over the top 12 % (at least 3) rows of its block.

    A state whose block never stands out takes its share of the rows in order.
    """
    rows = df.count()
    top = max(3, round(rows * 0.12))
    blocks = [lx.SEMANTIC_STATES[min(i, len(lx.SEMANTIC_STATES) - 1)][0] for i in range(n_states)]
    names = [f"z_{i}" for i in range(len(scaler.columns))]
    work = df.select(
        row, *[scaler.scaled(i).alias(n) for i, n in enumerate(names)],
        *[dominance(df, b).alias(f"gap_{b}") for b in dict.fromkeys(blocks)],
    )
    cuts = nth_largest(work, {b: F.col(f"gap_{b}") for b in dict.fromkeys(blocks)}, {b: top for b in blocks})
    means = np.zeros((n_states, len(names)))
    placed = None
    for i, block in enumerate(blocks):
        if cuts[block] is not None:
            means[i] = mean_of_top(work, F.col(f"gap_{block}"), top, names, cuts[block])
            continue
        if placed is None:
            placed = with_place(work, Ordering((), row), "_place")
        size, extra = divmod(rows, n_states)
        first = i * size + min(i, extra)
        chunk = placed.where(F.col("_place").between(first + 1, first + size + (i < extra)))
        found = chunk.agg(*[F.avg(c).alias(c) for c in names]).first()
        means[i] = [found[c] or 0.0 for c in names]
    return means, rows
