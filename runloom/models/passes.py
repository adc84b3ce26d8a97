"""Spark passes over segments: expected counts, links of long runs, decoding.

Every pass is one `mapInArrow` over the segment table. Tasks return partial sums
or decoded rows; nothing is gathered but a few numbers per state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .runs import Segments

FAN = 4096
SLICE_ROWS = 1 << 20


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _slices(batch: pa.RecordBatch, model) -> Iterator[tuple[pa.RecordBatch, np.ndarray, kernel.Slice]]:
    """Pieces of an Arrow batch small enough to hold all vectors in memory."""
    flat, offsets = _lists(batch, "x")
    ends = offsets[1:] // model.width
    at = 0
    while at < batch.num_rows:
        base = offsets[at] // model.width
        upto = max(int(np.searchsorted(ends, base + SLICE_ROWS, side="right")), at + 1)
        values = flat[offsets[at]: offsets[upto]].reshape(-1, model.width)
        starts = offsets[at:upto] // model.width - base
        yield batch.slice(at, upto - at), values, kernel.Slice(starts, ends[at:upto] - base - starts)
        at = upto


def _matrix(batch: pa.RecordBatch, name: str, n: int) -> np.ndarray:
    return _lists(batch, name)[0].reshape(-1, n)


def _borders(piece: pa.RecordBatch, model):
    """What enters and leaves each segment; plain start and end for whole runs."""
    count, n = piece.num_rows, model.n
    if "enter" not in piece.schema.names:
        none = np.full(count, -1)
        return np.zeros((count, n)), np.ones((count, n)), np.zeros(count, bool), none, none
    opens = piece.column("opens").to_numpy(zero_copy_only=False)
    enter_state = np.where(opens, -1, piece.column("enter_state").to_numpy())
    return (_matrix(piece, "enter", n), _matrix(piece, "leave", n), ~opens, enter_state,
            piece.column("exit_state").to_numpy())


def _posterior(piece, values, cut, model):
    b, log_b, offset = model.emission(values)
    enter, leave, continues, enter_state, exit_state = _borders(piece, model)
    prior = np.where(continues[:, None], enter @ model.trans, model.start)
    gamma, alpha, weighted, scale = kernel.forward_backward(b, cut, prior, model.trans, leave)
    return b, log_b, offset, enter, continues, enter_state, exit_state, gamma, alpha, weighted, scale


def _count(model):
    def task(batches):
        total = np.zeros(model.stats_size)
        for batch in batches:
            for piece, values, cut in _slices(batch, model):
                _, _, offset, enter, continues, _, _, gamma, alpha, weighted, scale = _posterior(piece, values, cut, model)
                mult = piece.column("mult").to_numpy()
                per_row = np.repeat(mult, cut.lengths)
                first = gamma[cut.starts[~continues]] * mult[~continues][:, None]
                total += np.concatenate([
                    [float(per_row @ (np.log(scale) + offset))],
                    first.sum(axis=0),
                    kernel.expected_moves(alpha, weighted, cut, model.trans, enter, continues, mult).ravel(),
                    model.gather(values, gamma * per_row[:, None]),
                ])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(total[used])], names=["place", "value"]
        )

    return task


def expected_counts(seg: Segments, model) -> np.ndarray:
    """One E-step: log-likelihood, start, moves and emission sums, added up by Spark."""
    schema = "place int, value double"
    sums = seg.whole.mapInArrow(_count(model), schema)
    if seg.has_parts:
        sums = sums.unionByName(_linked(seg, model).mapInArrow(_count(model), schema))
    rows = sums.groupBy("place").agg(F.sum("value").alias("value")).collect()  # one row per model number
    out = np.zeros(model.stats_size)
    for r in rows:
        out[r["place"]] = r["value"]
    return out


# --- long runs ----------------------------------------------------------------------

def _array(matrix: np.ndarray) -> list:
    return [row for row in matrix.reshape(len(matrix), -1)]


def _transfers(model, keys):
    def task(batches):
        for batch in batches:
            for piece, values, cut in _slices(batch, model):
                b, log_b, _ = model.emission(values)
                opens = piece.column("opens").to_numpy(zero_copy_only=False)
                m = kernel.transfer(b, cut, model.start, model.trans, opens)
                d = kernel.best_transfer(log_b, cut, model.log_start, model.log_trans, opens)
                kept = {k: piece.column(k) for k in (*keys, "seg")}
                kind = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [*kept.values(), pa.array(_array(m), kind), pa.array(_array(d), kind)], names=[*kept, "m", "d"]
                )

    return task


def _stack(cells: pd.Series, *shape: int) -> np.ndarray:
    return np.stack([np.asarray(c) for c in cells]).reshape(-1, *shape)


def links(parts: DataFrame, keys: tuple[str, ...], last_seg: int) -> DataFrame:
    """Vectors that enter and leave every segment of a run.

    Runs may have models of different size; a run's matrices tell its own.
    No task sees more than FAN segments: longer runs are multiplied up in groups
    of FAN, the groups are linked the same way, and the result is handed down.
    """
    names = list(keys)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name in keys)
    vectors = "enter array<double>, leave array<double>, score array<double>, enter_state bigint, exit_state bigint"

    def size(pdf: pd.DataFrame) -> int:
        return math.isqrt(len(pdf["m"].iloc[0]))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg")
        first, n = pdf.iloc[0], size(pdf)
        given = "b_enter" in pdf.columns
        out = kernel.link(
            _stack(pdf["m"], n, n), _stack(pdf["d"], n, n),
            np.asarray(first["b_enter"]) if given else np.full(n, 1.0 / n),
            np.asarray(first["b_leave"]) if given else np.ones(n),
            np.asarray(first["b_score"]) if given else np.zeros(n),
            int(first["b_exit"]) if given else -1,
        )
        res = pdf[[*names, "seg"]].copy()
        for name, value in zip(("enter", "leave", "score"), out[:3]):
            res[name] = _array(value)
        res["enter_state"], res["exit_state"] = out[3], out[4]
        return res

    schema = f"{key_schema}, seg bigint, {vectors}"
    if last_seg < FAN:
        return parts.groupBy(*names).applyInPandas(walk, schema)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, n = pdf.sort_values("seg"), size(pdf)
        res = pdf[names].head(1).copy()
        res["seg"] = int(pdf["seg"].iloc[0]) // FAN
        res["m"] = [kernel.multiply(_stack(pdf["m"], n, n)).ravel()]
        res["d"] = [kernel.multiply_best(_stack(pdf["d"], n, n)).ravel()]
        return res

    grouped = parts.withColumn("_group", F.floor(F.col("seg") / FAN).cast("long"))
    merged = grouped.groupBy(*names, "_group").applyInPandas(merge, f"{key_schema}, seg bigint, m array<double>, d array<double>")
    above = links(merged, keys, last_seg // FAN).select(
        *names, F.col("seg").alias("_group"), F.col("enter").alias("b_enter"), F.col("leave").alias("b_leave"),
        F.col("score").alias("b_score"), F.col("exit_state").alias("b_exit"),
    )
    return grouped.join(above, [*names, "_group"]).groupBy(*names, "_group").applyInPandas(walk, schema)


def _linked(seg: Segments, model) -> DataFrame:
    keys = seg.keys
    by_name = {f.name: f for f in seg.table.schema}
    schema = T.StructType([by_name[k] for k in (*keys, "seg")]).add("m", T.ArrayType(T.DoubleType())).add("d", T.ArrayType(T.DoubleType()))
    found = links(seg.parts.mapInArrow(_transfers(model, keys), schema), keys, seg.last_seg)
    return seg.parts.join(found, [*keys, "seg"])


# --- decoding -------------------------------------------------------------------------

def _decode(model, keys):
    def task(batches):
        for batch in batches:
            for piece, values, cut in _slices(batch, model):
                _, log_b, offset, _, _, enter_state, exit_state, gamma, _, _, scale = _posterior(piece, values, cut, model)
                path = kernel.best_paths(log_b, cut, model.log_start, model.log_trans, enter_state, exit_state)
                of_row = pa.array(np.repeat(np.arange(piece.num_rows), cut.lengths))
                columns = {k: piece.column(k).take(of_row) for k in keys}
                columns["row"] = piece.column("rows").flatten()
                columns["hidden_state"] = pa.array(path)
                columns.update({f"p_state_{i}": pa.array(np.ascontiguousarray(gamma[:, i])) for i in range(model.n)})
                columns["confidence"] = pa.array(gamma.max(axis=1))
                columns["log_scale"] = pa.array(np.log(np.maximum(scale, kernel.EPS)) + offset)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return task


def decode(seg: Segments, model, row: str = "source_row_index") -> DataFrame:
    """One row per input row: best-path state, posteriors, confidence, log scale.

    `log_scale` sums to the log-likelihood. The state comes from the best path
    and the posteriors from forward–backward, so the confidence may belong to
    another state.
    """
    kinds = {f.name: f.dataType for f in seg.table.schema}
    schema = T.StructType([T.StructField(k, kinds[k]) for k in seg.keys]).add("row", "long").add("hidden_state", "integer")
    for i in range(model.n):
        schema = schema.add(f"p_state_{i}", "double")
    schema = schema.add("confidence", "double").add("log_scale", "double")
    rows = seg.whole.mapInArrow(_decode(model, seg.keys), schema)
    if seg.has_parts:
        rows = rows.unionByName(_linked(seg, model).mapInArrow(_decode(model, seg.keys), schema))
    return rows.withColumnRenamed("row", row)
