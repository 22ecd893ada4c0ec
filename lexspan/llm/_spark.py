"""Session helpers of this subpackage: tables in the shared folder, bounded Arrow passes, whole files."""

from __future__ import annotations

import ctypes
import functools
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from ..storage import new_folder, shared_dir, written

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "appended", "bounded", "new_folder", "opened", "read_file", "settled", "shared_dir", "write_file", "written"]

#: Whether an execution's shuffle files go at its end; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Of a batch that a pass works on at once; a single longer row is a batch of its own.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096

Batches = Iterator[pa.RecordBatch]


def settled(df: DataFrame, name: str) -> DataFrame:
    """written, and the shuffle files that it took are removed at once: what follows reads the table only."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def release() -> None:
    """Gives freed memory back to the machine: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _sliced(batches: Batches) -> Batches:
    for batch in batches:
        n = batch.num_rows
        if not n:
            yield batch
            continue
        rows = max(1, min(BATCH_ROWS, n * BATCH_BYTES // max(batch.nbytes, 1)))
        for i in range(0, n, rows):
            yield batch.slice(i, rows)


def bounded(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run over batches of bounded size; the worker's freed memory is given back at the end of each task."""

    @functools.wraps(run)
    def passed(batches: Batches) -> Batches:
        try:
            yield from run(_sliced(batches))
        finally:
            release()

    return passed


def appended(docs: DataFrame, column: str, run: Callable[[Iterator[pa.Array]], Iterator[list[pa.Array]]], fields: list[StructField]) -> DataFrame:
    """docs with the columns _x0, _x1, ... that run makes of each batch of `column` (as string); its own are c0, c1, ... .

    Names in docs can't clash with anything, and the column goes to Python once and back once.
    """
    at = docs.columns.index(column)
    slim = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    extra = [StructField(f"_x{i}", f.dataType) for i, f in enumerate(fields)]
    cast = docs.schema[at].dataType.typeName() != "string"
    if cast:
        slim = slim.withColumn("_cast", F.col(f"c{at}").cast("string"))

    def mapped(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.Array]:
            for batch in batches:
                held.append(batch)
                yield batch.column(len(batch.schema) - 1 if cast else at)

        for new in run(texts()):
            batch = held.pop()
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *[f.name for f in extra]])

    return slim.mapInArrow(bounded(mapped), StructType([*slim.schema.fields, *extra]))


def _local(at: str) -> str | None:
    if at.startswith("file:"):
        return "/" + at[5:].lstrip("/")
    return at if "://" not in at else None


def write_file(at: str, data: bytes) -> None:
    """Writes a whole file under another name, then renames it: a second attempt of a task only replaces it."""
    local = _local(at)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, local)
        return
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(at)
    where.create_dir(inner.rpartition("/")[0], recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(part) as f:
        f.write(data)
    where.move(part, inner)


def opened(at: str):
    """A seekable file to read."""
    local = _local(at)
    if local is not None:
        return open(local, "rb")
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(at)
    return where.open_input_file(inner)


def read_file(at: str) -> bytes:
    with opened(at) as f:
        return f.read()
