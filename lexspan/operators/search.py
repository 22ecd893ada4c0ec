"""Vector search: filter first, then score, then rank. Queries are a bounded set; rows are not."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import written

#: Queries that are sent to every task at once; more are searched block by block. Rows and queries whose scores are held at once.
BLOCK, ROWS = 4096, 1024


def _scores(q: np.ndarray, m: np.ndarray, distance: str) -> np.ndarray:
    dots = q @ m.T
    if distance == "dot":
        return dots
    qn, mn = np.sqrt((q * q).sum(axis=1)), np.sqrt((m * m).sum(axis=1))
    if distance == "euclid":
        return 1 / (1 + np.sqrt(np.maximum(qn[:, None] ** 2 + mn[None, :] ** 2 - 2 * dots, 0)))
    n = qn[:, None] * mn[None, :]
    return np.divide(dots, n, out=np.zeros_like(dots), where=n > 0)


def _vectors(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose vectors have d components and none missing, their vectors)."""
    size = column.value_lengths().fill_null(-1).to_numpy()
    rows = np.flatnonzero(size == d)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), d)
    ok = np.isfinite(flat).all(axis=1)
    return rows[ok], flat[ok]


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, column) of each query's k best finite scores, by falling score and then id."""
    if s.shape[1] > k:
        a, b = np.nonzero(s >= np.partition(s, -k, axis=1)[:, -k][:, None])
    else:
        a, b = np.nonzero(np.ones(s.shape, bool))
    ok = np.isfinite(s[a, b])
    a, b = a[ok], b[ok]
    order = np.lexsort((ids[b], -s[a, b], a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], b[place < k]


def _local_top(shared, k: int, distance: str, same_scope: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qscope, q = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                rows, m = _vectors(some.column("embedding"), q.shape[1])
                if not len(rows):
                    continue
                ids = some.column("id").take(pa.array(rows)).to_numpy()
                scope = some.column("scope").take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(float)  # null is nan, which equals nothing
                for i in range(0, len(qid), ROWS):
                    s = np.round(_scores(q[i : i + ROWS], m, distance), 12)
                    if same_scope:
                        s = np.where(qscope[i : i + ROWS, None] == scope[None, :], s, -np.inf)
                    a, b = _best(s, ids, k)
                    yield pa.record_batch([pa.array(qid[i + a]), pa.array(ids[b]), pa.array(s[a, b])], ["query_id", "id", "score"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int, distance: str = "cosine", same_scope: bool = False) -> DataFrame:
    """query_id, id, score, rank: the k best rows for each query, by falling score and then id.

    rows: id, embedding, scope; queries: query_id, embedding, scope. With same_scope, only rows of the
    query's scope take part; that filter comes before the ranking, and a null scope is equal to none.
    Vectors that are null, of another length than the queries', or not finite throughout take no part.
    Queries go in blocks of BLOCK; each block but a single one is a job whose broadcast is destroyed after it.
    """
    spark, found = rows.sparkSession, None
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    slim = rows.select("id", F.col("scope").cast("long").alias("scope"), F.col("embedding").cast("array<double>").alias("embedding")).where("id IS NOT NULL")
    own = queries.select("query_id", F.col("scope").cast("long").alias("scope"), F.col("embedding").cast("array<double>").alias("embedding"))
    local = own.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())).toLocalIterator()
    block = list(islice(local, BLOCK))
    while block:
        size = max(len(r["embedding"]) for r in block)
        block = [r for r in block if len(r["embedding"]) == size]
        scope = np.array([np.nan if r["scope"] is None else r["scope"] for r in block], float)
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in block]), scope, np.array([r["embedding"] for r in block], float)))
        one = slim.mapInArrow(_local_top(shared, k, distance, same_scope), "query_id long, id long, score double")
        one = one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        block = list(islice(local, BLOCK))
        if block or found is not None:
            one = written(one, "search")
            shared.destroy()
        found = one if found is None else found.unionAll(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    return found


def in_scope(index_id: Column | str, version: str, document: str | None = None, units: list[str] | None = None) -> Column:
    """Condition on vector records: index, version, document and units, applied before any ranking."""
    ok = (F.col("document_index_id") == index_id) & (F.col("index_version") == version)
    if document is not None:
        ok &= F.col("document_id") == document
    if units is not None:
        ok &= F.col("semantic_unit_id").isin(units)
    return ok
