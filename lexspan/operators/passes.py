"""Arrow passes over the rows of one key after another: one exchange, and memory bounded by a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a pass gives back at once, and bytes of a batch that it works on at once.
ROWS, BYTES = 1024, 4 << 20


def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """(key, its rows in batches) of batches whose first column, the key, is in order."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        runs, at = pc.run_end_encode(batch.column(0)), 0
        for k, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if held and k != key:
                yield key, held
                held = []
            key = k
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield key, held


def tabled(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows as batches of bounded size."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= ROWS:
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches in parts of about BYTES; a single longer row is a part of its own."""
    for batch in batches:
        rows = max(1, batch.num_rows * BYTES // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_text(docs: DataFrame, made: Callable[[str], str]) -> DataFrame:
    """doc_id and text of docs, each text as made gives it; it goes to Python once and back once, a few MB at a time."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else made(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(passed, rows.schema)


def by_key(rows: DataFrame, schema: StructType, run: Callable[[object, list[pa.RecordBatch]], Iterable[tuple]], order: list[str] | None = None) -> DataFrame:
    """What run(key, batches) gives for all rows of each key, the first column of rows; they come in that order, if one is asked for."""
    key, kinds = rows.columns[0], to_arrow_schema(schema)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tabled((r for k, held in groups(batches) for r in run(k, held)), kinds)

    return rows.repartition(key).sortWithinPartitions(key, *(order or [])).mapInArrow(passed, schema)
