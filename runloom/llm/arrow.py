"""Row-wise Arrow work inside tasks, in slices of bounded size."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of input text per slice; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `SLICE_BYTES` in one of its columns."""
    held = batch.column(column)
    length = pc.multiply(pc.list_value_length(held), 4) if pa.types.is_list(held.type) else pc.binary_length(held)
    sizes = pc.fill_null(length, 0).to_pylist()
    start, held = 0, 0
    for at, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def finish() -> None:
    """Gives back what a task's batches took: the Python worker lives on, idle, beside the tasks of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def add_columns(
    df: DataFrame, column: str, keep: Sequence[str], make: Callable[[], Callable[[pa.Array], Sequence[pa.Array]]], fields: Sequence[T.StructField],
    after: Callable[[], None] = lambda: None,
) -> DataFrame:
    """Kept columns and what `make()` computes from `column`, slice by slice.

    `make` runs once per task; what it returns maps an array to one array per field.
    `after` runs at the end of a task.
    """
    source = df.select(*keep, df[column].alias("__input"))
    schema = T.StructType([*source.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                made = work(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[f.name for f in schema.fields])
        del work
        after()
        finish()

    return source.mapInArrow(run, schema)
