"""Row-wise work on Arrow batches inside Spark tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Batches are cut to about so many bytes, so that long texts don't add up.
SLICE_BYTES = 8 << 20


_kept: dict[str, dict] = {}


def kept(kind: str) -> dict:
    """What this Python worker keeps from task to task of one kind; the first task of any other kind lets go of it."""
    return _kept.setdefault(kind, {})


def let_go(kind: str) -> None:
    """End what tasks of other kinds have kept in this worker."""
    for other in [k for k in _kept if k != kind]:
        del _kept[other]


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that gives freed memory back to the system when its task ends: Spark keeps workers, idle, for later tasks.

    What tasks of another ``kind`` have kept in the worker goes when it begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(kind)  # by reference: what is pickled by value would have a dictionary of its own
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes, of one row at least."""
    if batch.num_rows == 0:
        return
    step = max(1, batch.num_rows * limit // max(1, batch.get_total_buffer_size()))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session's Python tasks small; only a smaller setting stays as it is."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = str(spark.conf.get(key)).lower()
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def map_columns(df: DataFrame, run: Callable[[pa.RecordBatch], dict], keep: tuple[str, ...], schema: str, limit: int = SLICE_BYTES, kind: str = "") -> DataFrame:
    """df's columns ``keep`` and the new columns that ``run`` gives for each batch, of the same length.

    A new column takes the place of a kept one of its name. ``kind`` names what ``run`` keeps in the worker.
    """
    new = T.StructType.fromDDL(schema)
    keep = tuple(c for c in keep if c not in new.names)
    out = T.StructType([df.schema[c] for c in keep] + new.fields)
    arrow = to_arrow_schema(new)

    bound_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit):
                made = run(batch)
                columns = [batch.column(c) for c in keep]
                columns += [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *arrow.names])

    return df.mapInArrow(tidy(work, kind), out)
