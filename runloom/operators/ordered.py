"""Ordered scans that stay parallel when one key holds most of the rows.

A plain window puts a whole key into one task. `Ordering.inspect` counts rows
per key once; keys above `block` rows are hot, and for these only, rows are cut
into blocks. The borders of the blocks are ranks, not values: every so many-th of a
hashed sample of the key's order values, so blocks have about half of `block` rows
however the values are spread. Each block is scanned as its own partition, and
a table with one row per block carries the state from block to block. All other
keys use the plain window. Results are the same either way.

Key columns must not be null (the episode builder never leaves them null), and
`row` must be an integer that is unique within a key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import park

BLOCK = 1 << 20
#: Sampled order values for a block, and borders of all hot keys at most (they are broadcast); with more rows, blocks grow.
SAMPLED, MOST_BORDERS = 64, 1 << 22
#: Slots of hashed keys that are counted before any key is, and crowded slots that are worth a filter.
SLOTS, FEW_SLOTS = 1 << 16, 1 << 10
Cells = dict[str, Column]


@dataclass(frozen=True)
class Ordering:
    """Keys, order column, and what `inspect` finds: the hot keys with the borders of their blocks.

    No keys means one global order, which is always cut into blocks: by
    `row div block` unless it was inspected.
    """

    keys: tuple[str, ...]
    row: str
    block: int = BLOCK
    hot: DataFrame | None = None

    def inspect(self, df: DataFrame) -> "Ordering":
        """Count rows per key (map-side combined); for the hot keys, choose the borders of their blocks.

        There are at most rows / block hot keys. A hot key makes its slot of hashed keys hot
        too, so slots are counted first, and keys in crowded slots only.
        """
        if self.keys:
            slot = F.pmod(F.xxhash64(*self.keys), F.lit(SLOTS))
            slots = df.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > self.block)
            found = [r["_slot"] for r in slots.select("_slot").collect()]  # SLOTS numbers at most
            if not found:
                return replace(self, hot=None)
            if len(found) <= FEW_SLOTS:
                df = df.where(slot.isin(found))
        crowded = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > self.block)
        if self.keys:
            if crowded.isEmpty():
                return replace(self, hot=None)
            crowded = park(crowded, "crowded")
        total = crowded.agg(F.sum("_n")).first()[0]
        if not total:
            return replace(self, hot=None)
        block = max(self.block, -(-2 * total // MOST_BORDERS))
        rate = max(1, block // SAMPLED)
        sample = df.select(*self.keys, F.col(self.row).alias("_at")).where(F.pmod(F.xxhash64("_at"), F.lit(rate)) == 0)
        if self.keys:
            sample = sample.join(crowded.drop("_n"), list(self.keys), "left_semi")
        sample = park(sample, "sample")
        ranked = sample.withColumn("_p", F.row_number().over(Window.partitionBy(*self.keys).orderBy("_at")))
        chosen = ranked.where(F.col("_p") % max(1, block // 2 // rate) == 0)
        borders = chosen.groupBy(*self.keys).agg(F.array_sort(F.collect_list("_at")).alias("_borders"))  # two for each block
        return replace(self, hot=park(borders, "hot"))

    @property
    def blocked(self) -> bool:
        return not self.keys or self.hot is not None

    def with_block(self, df: DataFrame) -> DataFrame:
        if self.hot is None:
            return df.withColumn("_blk", F.lit(-1).cast("long") if self.keys else F.floor(F.col(self.row) / F.lit(self.block)).cast("long"))
        if not self.keys:
            return df.withColumn("_borders", self.hot.scalar()).withColumn("_blk", self.slot()).drop("_borders")
        # bounded by MOST_BORDERS
        flagged = df.join(F.broadcast(self.hot), list(self.keys), "left")
        return flagged.withColumn("_blk", F.when(F.col("_borders").isNotNull(), self.slot()).otherwise(F.lit(-1).cast("long"))).drop("_borders")

    def slot(self) -> Column:
        """How many borders a row has reached: a binary search over the sorted borders."""
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(MOST_BORDERS.bit_length()))])
        reached = lambda at, step: F.get("_borders", at + step - 1) <= F.col(self.row)
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(at, step), at + step).otherwise(at)).cast("long")

    def hot_rows(self, df: DataFrame) -> DataFrame:
        return df.join(self.hot.drop("_borders"), list(self.keys), "left_semi") if self.keys else df

    def inner(self):
        """Window over the rows of one key, or of one block of a hot key."""
        parts = [*self.keys, "_blk"] if self.blocked else list(self.keys)
        return Window.partitionBy(*parts).orderBy(self.row)

    def across(self):
        """Window over the blocks of one key: rows / block entries at most."""
        return Window.partitionBy(*self.keys).orderBy("_blk")


def _pack(names: list[str], alias: str) -> Column:
    return F.struct(*[F.col(n).alias(f"c{i}") for i, n in enumerate(names)]).alias(alias)


def _unpack(names: list[str], packed: str) -> Cells:
    return {n: F.col(packed)[f"c{i}"] for i, n in enumerate(names)}


def _edges(df: DataFrame, order: Ordering, watch: list[str], *more: Column) -> DataFrame:
    """One row per hot block: its first and last watched cells."""
    cells = _pack(watch, "cells")
    return (
        order.with_block(order.hot_rows(df))
        .groupBy(*order.keys, "_blk")
        .agg(F.min_by(cells, order.row).alias("_head"), F.max_by(cells, order.row).alias("_tail"), *more)
    )


def number_breaks(
    df: DataFrame,
    order: Ordering,
    watch: list[str],
    is_break: Callable[[Cells, Cells], Column],
    number: str = "run_no",
) -> DataFrame:
    """Cut each key into runs where `is_break(previous, current)` holds.

    Adds `number` (0-based run within the key), `_at` (0-based place within the
    key), `_opens` and `_closes` (first / last row of the run). A null test is
    no break.
    """
    now = {n: F.col(n) for n in watch}

    def broken(before: str, after: Cells) -> Column:
        return F.coalesce(is_break(_unpack(watch, before), after), F.lit(False))

    w = order.inner()
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = order.with_block(df)
    local = (
        base.withColumn("_prev", F.lag(_pack(watch, "cells")).over(w))
        .withColumn("_next", F.lead(_pack(watch, "cells")).over(w))
        .withColumn("_cut", F.col("_prev").isNotNull() & broken("_prev", now))
    )
    after = {n: F.col("_next")[f"c{i}"] for i, n in enumerate(watch)}
    held = F.struct(*[F.col(n).alias(f"c{i}") for i, n in enumerate(watch)])
    local = local.withColumn("_cell", held).withColumn("_cut_next", broken("_cell", after))
    local = local.withColumn("_cuts", F.sum(F.col("_cut").cast("long")).over(running)).withColumn(
        "_seen", (F.row_number().over(w) - 1).cast("long")
    )
    work = ["_blk", "_prev", "_next", "_cut", "_cell", "_cut_next", "_cuts", "_seen"]
    if not order.blocked:
        return (
            local.withColumn(number, F.col("_cuts")).withColumn("_at", F.col("_seen"))
            .withColumn("_opens", F.col("_prev").isNull() | F.col("_cut"))
            .withColumn("_closes", F.col("_next").isNull() | F.col("_cut_next"))
            .drop(*work)
        )

    hot_local = (
        order.with_block(order.hot_rows(df))
        .withColumn("_prev", F.lag(_pack(watch, "cells")).over(w))
        .withColumn("_cut", F.col("_prev").isNotNull() & broken("_prev", now))
    )
    cells = _pack(watch, "cells")
    across = order.across()
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    upto = across.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = (
        hot_local.groupBy(*order.keys, "_blk")
        .agg(
            F.min_by(cells, order.row).alias("_head"), F.max_by(cells, order.row).alias("_tail"),
            F.sum(F.col("_cut").cast("long")).alias("_inside"), F.count(F.lit(1)).alias("_rows"),
        )
        .withColumn("_c_prev", F.lag("_tail").over(across))
        .withColumn("_c_next", F.lead("_head").over(across))
    )
    heads = {n: F.col("_head")[f"c{i}"] for i, n in enumerate(watch)}
    nexts = {n: F.col("_c_next")[f"c{i}"] for i, n in enumerate(watch)}
    carry = (
        carry.withColumn("_edge", F.col("_c_prev").isNotNull() & broken("_c_prev", heads))
        .withColumn("_edge_next", broken("_tail", nexts))
        .withColumn(
            "_c_cuts",
            F.coalesce(F.sum("_inside").over(before), F.lit(0)) + F.sum(F.col("_edge").cast("long")).over(upto),
        )
        .withColumn("_c_seen", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .select(*order.keys, "_blk", "_c_prev", "_c_next", "_edge", "_edge_next", "_c_cuts", "_c_seen")
    )
    joined = local.join(carry, [*order.keys, "_blk"], "left")
    opens = F.when(
        F.col("_prev").isNull(), F.col("_c_prev").isNull() | F.coalesce(F.col("_edge"), F.lit(True))
    ).otherwise(F.col("_cut"))
    closes = F.when(
        F.col("_next").isNull(), F.col("_c_next").isNull() | F.coalesce(F.col("_edge_next"), F.lit(True))
    ).otherwise(F.col("_cut_next"))
    return (
        joined.withColumn(number, F.col("_cuts") + F.coalesce(F.col("_c_cuts"), F.lit(0)))
        .withColumn("_at", F.col("_seen") + F.coalesce(F.col("_c_seen"), F.lit(0)))
        .withColumn("_opens", opens)
        .withColumn("_closes", closes)
        .drop(*work, "_c_prev", "_c_next", "_edge", "_edge_next", "_c_cuts", "_c_seen")
    )


def with_next(df: DataFrame, order: Ordering, columns: list[str], prefix: str = "next_") -> DataFrame:
    """The same columns of the following row of the key, null on the last row."""
    return _shifted(df, order, columns, prefix, forward=True)


def with_previous(df: DataFrame, order: Ordering, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """The same columns of the row before, null on the first row of the key."""
    return _shifted(df, order, columns, prefix, forward=False)


def _shifted(df: DataFrame, order: Ordering, columns: list[str], prefix: str, forward: bool) -> DataFrame:
    step = F.lead if forward else F.lag
    out = order.with_block(df).withColumn("_near", step(_pack(columns, "cells")).over(order.inner()))
    if order.blocked:
        edges = _edges(df, order, columns)
        source = "_head" if forward else "_tail"
        edges = edges.withColumn("_far", step(source).over(order.across())).select(*order.keys, "_blk", "_far")
        out = out.join(edges, [*order.keys, "_blk"], "left").withColumn("_near", F.coalesce("_near", "_far"))
    for i, name in enumerate(columns):
        out = out.withColumn(prefix + name, F.col("_near")[f"c{i}"])
    return out.drop("_near", "_far", "_blk")


def fill_down(df: DataFrame, order: Ordering, columns: list[str]) -> DataFrame:
    """Replace nulls by the last value above within the key."""
    w = order.inner().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = order.with_block(df)
    for name in columns:
        out = out.withColumn(f"_f_{name}", F.last(name, ignorenulls=True).over(w))
    if order.blocked:
        lasts = [
            F.max_by(F.when(F.col(n).isNotNull(), F.col(n)), F.when(F.col(n).isNotNull(), F.col(order.row))).alias(f"_l_{n}")
            for n in columns
        ]
        above = order.across().rowsBetween(Window.unboundedPreceding, -1)
        tails = order.with_block(order.hot_rows(df)).groupBy(*order.keys, "_blk").agg(*lasts)
        for n in columns:
            tails = tails.withColumn(f"_c_{n}", F.last(f"_l_{n}", ignorenulls=True).over(above))
        tails = tails.select(*order.keys, "_blk", *[f"_c_{n}" for n in columns])
        out = out.join(tails, [*order.keys, "_blk"], "left")
        for n in columns:
            out = out.withColumn(f"_f_{n}", F.coalesce(f"_f_{n}", f"_c_{n}")).drop(f"_c_{n}")
    for name in columns:
        out = out.withColumn(name, F.col(f"_f_{name}")).drop(f"_f_{name}")
    return out.drop("_blk")


def over_key(df: DataFrame, order: Ordering, **aggregates: Column) -> DataFrame:
    """Add whole-key aggregates to every row.

    A hot key is aggregated with map-side combine and its one row joined back.
    """
    if not order.keys:
        for name, expr in aggregates.items():
            df = df.withColumn(name, df.agg(expr).scalar())
        return df
    out = order.with_block(df)
    parts = [*order.keys, "_blk"] if order.blocked else list(order.keys)
    for name, expr in aggregates.items():
        out = out.withColumn(name, expr.over(Window.partitionBy(*parts)))
    if order.hot is not None:
        whole = order.hot_rows(df).groupBy(*order.keys).agg(*[e.alias(f"_w_{n}") for n, e in aggregates.items()])
        out = out.join(whole, list(order.keys), "left")
        for name in aggregates:
            out = out.withColumn(name, F.coalesce(f"_w_{name}", name)).drop(f"_w_{name}")
    return out.drop("_blk")


def with_place(df: DataFrame, order: Ordering, place: str = "place", total: str | None = None) -> DataFrame:
    """1-based place of each row within its key, and optionally the key's row count."""
    out = number_breaks(df, order, [order.row], lambda before, now: F.lit(False), number="_one")
    out = out.withColumn(place, F.col("_at") + 1).drop("_one", "_at", "_opens", "_closes")
    return out if total is None else over_key(out, order, **{total: F.count(F.lit(1))})
