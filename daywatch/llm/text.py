"""Helpers of the text operators: free column names, text batches, stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from daywatch.session import scratch_path

#: Text bytes that a Python function works on at once, and bytes that Spark hands it at once.
BATCH_BYTES = 4 << 20
HANDED_BYTES = 8 << 20
_HANDED = "spark.sql.execution.arrow.maxBytesPerBatch"

#: The white space that separates words; what bytes.split() takes as white space.
SPACES = " \t\n\x0b\x0c\r"


def small_batches(df: DataFrame) -> DataFrame:
    """The frame, after holding its session to small Arrow batches unless it is held to some already.

    Spark's own bound, 64 MB a batch, is kept several times over by a task and its worker: too much
    where rows are whole texts.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_HANDED).rstrip("b")) > HANDED_BYTES:
        conf.set(_HANDED, str(HANDED_BYTES))
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and no lineage behind it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def pieces(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of text each, one row at least."""
    rows, at = batch.num_rows, 0
    pa.default_memory_pool().release_unused()
    if not rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    yield batch.slice(at)


def texts_of(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def with_columns(
    df: DataFrame,
    text: str,
    fields: list[StructField],
    fn: Callable[[list[bytes | None]], list[pa.Array]],
    most: int = BATCH_BYTES,
) -> DataFrame:
    """Add ``fields`` that ``fn`` derives from the UTF-8 bytes of the column ``text``, about ``most`` bytes at once."""
    at = df.columns.index(text)
    names = [*df.columns, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, at, most):
                yield pa.RecordBatch.from_arrays([*batch.columns, *fn(texts_of(batch, at))], names=names)

    return small_batches(df).mapInArrow(run, StructType([*df.schema.fields, *fields]))
