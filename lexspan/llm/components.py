"""Connected components of links: tasks join the links that they hold, then large and small stars alternate.

State is a table of links in the shared folder. As many tasks as the number of links asks for turn theirs
into stars, `HELD` at a time; what one task can hold is done then, and only more is joined by stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _spark

#: Links that a task joins by itself at a time.
HELD = 1 << 18


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the links, the smallest id that each reaches). Larger roots go below smaller ones, so each round halves those that have links, at least."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, top = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        x, y = top[x], top[y]
        apart = x != y
        if not apart.any():
            return ids, ids[top]
        x, y = x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (top[top] != top).any():
            top = top[top]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, smallest id that it reaches) of every id in the task's links, taken HELD at a time."""

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([r.column(k).to_numpy() for r in held]) for k in (0, 1))
        ids, low = smallest(a, b)
        return pa.record_batch([pa.array(ids), pa.array(low)], ["a", "b"])

    held, total = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, HELD - total))
            batch = batch.slice(held[-1].num_rows)
            total += held[-1].num_rows
            if total == HELD:
                yield close(held)
                held, total = [], 0
    if held:
        yield close(held)


def _contracted(links: DataFrame, many: int) -> DataFrame:
    """The stars of each task, with their centres as links of their own; as few tasks as hold all."""
    return _spark.settled(links.coalesce(max(1, -(-many // HELD))).mapInArrow(_spark.bounded(_stars), "a long, b long"), "links")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in a link (a, b) between different ids, as a table; the component is its smallest id."""
    edges = _spark.settled(links.select("a", "b").where("a <> b"), "links")
    many = edges.count()
    edges = _contracted(edges, many)
    if many > HELD:
        many = edges.count()
        edges = _contracted(edges, many) if many <= HELD else _starred(edges.where("a <> b").distinct())
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _starred(edges: DataFrame) -> DataFrame:
    """(a, b) of every id a in a link a > b, with the smallest that it reaches."""
    edges = _spark.settled(edges, "links")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state(edges)
    while before[0]:
        edges = _spark.settled(_star(_spark.settled(_star(edges, True), "links"), False), "links")
        now = state(edges)
        if now == before:
            break
        before = now
    return _spark.settled(edges.unionByName(edges.select("b", F.col("b").alias("a")).distinct()), "components")
