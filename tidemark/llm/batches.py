"""One Python function over a column, a batch at a time, with other columns passed by untouched."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Rows of a batch that are Python objects at one time.
SLICE_ROWS = 500
#: Rows and bytes of an Arrow batch: set on the session where it has Spark's own values (10,000 rows, 64 MB).
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "3145728b"),
}


def give_back() -> None:
    """Hands the memory that a task has freed back to the system: workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def in_arrow(
    rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with batches bounded in rows and bytes, and workers that keep no freed memory."""
    conf = rows.sparkSession.conf
    for key, (usual, ours) in BATCH.items():
        if conf.get(key) == usual:
            conf.set(key, ours)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return rows.mapInArrow(run, schema)


def fresh(columns: list[str], name: str) -> str:
    """``name``, or with a number at its end if a column, in whatever case, is called so."""
    taken = {c.lower() for c in columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(columns) + 2))) if n.lower() not in taken)


def map_column(
    rows: DataFrame, kept: list[str], value: Column, make: Callable[[list], dict[str, object]], schema: str
) -> DataFrame:
    """``kept`` of every row with the columns that ``make`` gives for a list of at most ``SLICE_ROWS`` of ``value``.

    ``schema`` is the made columns' DDL. The kept columns stay in Arrow, so nulls and large integers
    pass unchanged. Rows stay in their partitions; a task holds one Arrow batch at a time, and one
    slice of it as Python objects.
    """
    held = rows.select(*kept).schema
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in held] + [schema])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = make(part.column(part.num_columns - 1).to_pylist())
                columns = [v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*part.schema.names[:-1], *made])

    return in_arrow(rows.select(*kept, value.alias(fresh(kept, "value"))), work, ddl)
