"""Exact top-k search by inner product, a block at a time.

Vectors are ranged by their nearest of `PIVOTS` drawn ones and cut into blocks of `BLOCK` consecutive rows.
A block's forward index is its matrix; its summary is the largest and smallest value of each term, and
its centre and radius. Two bounds hold for every score in a block: the summed term maxima for the query,
and the centre's score plus the query's length times the radius; the lower one counts. Blocks are taken
by falling bound, in `ROUNDS`: a few first, whose scores give each query a k-th best, then more, each
round with the k-th of the one before, until no block's bound reaches it. Summaries are read in groups
of about `SUMMARIES` blocks, each a pass of its own, so what is broadcast and what the driver holds are
bounded whatever the number of vectors. Pivots only decide the order of rows. Whether anything is pruned
depends on the vectors: those without clusters, in many dimensions, all lie within every block's bound.

Defined results: rows with a null id, a null vector, or a null or non-finite component take no part;
shorter vectors count as padded with zeros; a row never matches a query of the same id; of queries with
one id, that with the smallest bytes asks; equal scores go by the smaller id, repeated rows count each;
with fewer than k candidates all are given; an empty table gives no rows. Scores beyond a long wrap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window, functions as F

from . import _spark

BLOCK, PIVOTS, SUMMARIES, CHUNK, ROUNDS = 256, 256, 8192, 256, (2, 16, 128, None)


def _floats(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components as double, padded)."""
    column = column.cast(pa.list_(pa.float64()))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = np.where(np.asarray(column.is_valid()), np.asarray(column.value_lengths().fill_null(0)), 0).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    x = np.zeros((len(size), d))
    x[row, place] = flat
    ok = np.asarray(column.is_valid()) & np.isfinite(x).all(axis=1)
    return np.flatnonzero(ok), x[ok]


def _quantised(d: int, kind: str, pivots: np.ndarray, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _floats(batch.column(1), d)
            v = np.floor(scale * x)
            near = (v @ pivots.T).argmax(axis=1) if len(pivots) and len(v) else np.zeros(len(v), np.int64)
            raw = np.ascontiguousarray(v.astype(kind))
            yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(near, pa.int32()), pa.array([r.tobytes() for r in raw], pa.binary())], ["vec_id", "near", "v"])

    return run


def _blocks(d: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids, near, vs = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal k
            m = np.frombuffer(b"".join(vs), kind).reshape(len(vs), d)
            order = np.argsort(np.array(ids), kind="stable")
            m, who = m[order], np.array(ids)[order]
            centre = m.mean(axis=0, dtype=float)
            radius = float(np.sqrt(((m - centre) ** 2).sum(axis=1).max()))
            raw = [pa.array([x.tobytes()], pa.binary()) for x in (who.astype(np.int64), m, m.max(axis=0), m.min(axis=0), centre)]
            out = pa.record_batch([pa.array([(part << 32) + k]), pa.array([int(who[0])]), *raw, pa.array([radius])], ["block", "least", "ids", "rows", "hi", "lo", "centre", "radius"])
            k += 1
            ids.clear(), near.clear(), vs.clear()
            return out

        for batch in batches:
            for i, c, v in zip(batch.column("vec_id").to_pylist(), batch.column("near").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if ids and (len(ids) >= BLOCK or c != near[-1] and len(ids) >= BLOCK // 4):
                    yield close()
                ids.append(i), near.append(c), vs.append(v)
        if ids:
            yield close()

    return run


def _bounds(q: np.ndarray, hi: np.ndarray, lo: np.ndarray, centre: np.ndarray, radius: np.ndarray, exact: bool) -> np.ndarray:
    """An upper bound of the scores of each query with the rows of each block. Sums of whole numbers are exact if `exact`; other terms get a margin."""
    maxima = np.maximum(q, 0).astype(float) @ hi.T + np.minimum(q, 0).astype(float) @ lo.T
    q = q.astype(float)
    length = np.sqrt((q * q).sum(axis=1))
    near = q @ centre.T + length[:, None] * radius[None, :]
    margin = 1e-9 * length[:, None] * (np.sqrt((centre * centre).sum(axis=1)) + radius)[None, :] + 1e-6
    if not exact:
        maxima = maxima + 1e-9 * length[:, None] * np.sqrt(np.maximum(hi * hi, lo * lo).sum(axis=1))[None, :]
    return np.minimum(maxima, near + margin)


def _asked(d: int, kind: str, exact: bool, summaries, skip: int, take: int | None):
    """For each block, the queries that it may still serve: those in whose order of bounds it comes after `skip` and within `take`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, least, hi, lo, centre, radius = summaries.value
        hi, lo = hi.astype(float), lo.astype(float)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                q = np.frombuffer(b"".join(some.column("q").to_pylist()), kind).reshape(-1, d)
                qid = some.column("query_id").to_numpy()
                kth, kth_id = some.column("kth").to_numpy(), some.column("kth_id").to_numpy()
                bound = _bounds(q, hi, lo, centre, radius, exact)
                live = (bound > kth[:, None]) | ((bound == kth[:, None]) & (least[None, :] < kth_id[:, None]))
                if skip or take is not None:
                    place = np.empty(bound.shape, np.int64)
                    np.put_along_axis(place, np.argsort(-bound, axis=1, kind="stable"), np.arange(len(blocks))[None, :], axis=1)
                    live &= (place >= skip) & (place < (len(blocks) if take is None else skip + take))
                for b in np.flatnonzero(live.any(axis=0)).tolist():
                    w = np.flatnonzero(live[:, b])
                    yield pa.record_batch([pa.array([int(blocks[b])]), pa.array([qid[w].astype(np.int64).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(q[w]).tobytes()], pa.binary()), pa.array([kth[w].tobytes()], pa.binary())], ["block", "qids", "qs", "kths"])

    return run


def _scored(d: int, kind: str, k: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, m = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], kind).reshape(-1, d)
                qid, q, kth = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["qs"], kind).reshape(-1, d), np.frombuffer(r["kths"], float)
                s = q.astype(float) @ m.T.astype(float) if exact else q.astype(np.int64) @ m.T.astype(np.int64)
                s = np.where(qid[:, None] == ids[None, :], -np.inf, s) if exact else s
                best = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
                got = np.take_along_axis(s, best, axis=1)
                ok = (got >= kth[:, None]) & (qid[:, None] != ids[best])
                if exact:
                    ok &= np.isfinite(got)
                a, b = np.nonzero(ok)
                yield pa.record_batch([pa.array(qid[a]), pa.array(ids[best[a, b]]), pa.array(got[a, b].astype(np.int64))], ["query_id", "vec_id", "score"])

    return run


class Report:
    """(query, block) pairs in all, and those that were scored."""

    def __init__(self) -> None:
        self.pairs = self.scored = 0

    @property
    def pruned(self) -> float:
        return 1 - self.scored / self.pairs if self.pairs else 0.0


def search(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, report: Report | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id, embedding; is_query: a condition on vec_id that picks the queries."""
    spark, report = vectors.sparkSession, report or Report()
    none = "query_id long, rank int, vec_id long, score long"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull())
    rows = rows.where(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    shape = rows.agg(F.max(F.size("e")).alias("d"), F.max(F.array_max(F.transform("e", lambda x: F.abs(x)))).alias("top"), F.count("*").alias("n")).first()
    if not shape["n"]:
        return spark.createDataFrame([], none)
    d, top = max(1, shape["d"] or 0), (shape["top"] or 0.0) * scale + 1
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8"
    exact = d * top * top < 2**53
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()  # PIVOTS rows
    pivots = np.zeros((len(drawn), d))
    for i, r in enumerate(drawn):
        pivots[i, : len(r["e"])] = np.array(r["e"], float)
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-9)
    ints = _spark.written(rows.mapInArrow(_spark.bounded(_quantised(d, kind, pivots, scale)), "vec_id long, near int, v binary"), "vectors")
    parts = max(1, -(-shape["n"] // 4096), ints.rdd.getNumPartitions())
    blocks = ints.repartitionByRange(parts, "near", "vec_id").sortWithinPartitions("near", "vec_id").mapInArrow(_blocks(d, kind), "block long, least long, ids binary, rows binary, hi binary, lo binary, centre binary, radius double")
    blocks = _spark.written(blocks, "blocks")
    queries = _spark.written(ints.where(is_query(F.col("vec_id"))).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q")), "queries")
    n_queries, n_blocks = queries.count(), blocks.count()
    report.pairs += n_queries * n_blocks
    groups = max(1, -(-n_blocks // SUMMARIES))
    best = None
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for g in range(groups if n_queries else 0):
        group = blocks.where(F.pmod(F.xxhash64("block"), F.lit(groups)) == g)
        got = sorted(group.select("block", "least", "hi", "lo", "centre", "radius").collect())  # about SUMMARIES rows
        if not got:
            continue
        matrix = lambda c, x=kind: np.stack([np.frombuffer(r[c], x) for r in got])  # noqa: E731, B023
        shared = spark.sparkContext.broadcast((np.array([r["block"] for r in got]), np.array([r["least"] for r in got]), matrix("hi"), matrix("lo"), matrix("centre", float), np.array([r["radius"] for r in got])))
        skip = 0
        for take in ROUNDS:
            if skip >= len(got):
                break
            if best is None:
                asked = queries.select("query_id", "q", F.lit(float("-inf")).alias("kth"), F.lit(0).cast("long").alias("kth_id"))
            else:
                kth = best.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"), F.col("vec_id").alias("kth_id"))
                asked = queries.join(kth, "query_id", "left").select("query_id", "q", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"), F.coalesce("kth_id", F.lit(0).cast("long")).alias("kth_id"))
            seen = Observation()
            pairs = asked.mapInArrow(_asked(d, kind, exact, shared, skip, take), "block long, qids binary, qs binary, kths binary").observe(seen, F.coalesce(F.sum(F.octet_length("qids")), F.lit(0)).alias("bytes"))
            found = pairs.join(group.select("block", "ids", "rows"), "block").select("qids", "qs", "kths", "ids", "rows").mapInArrow(_scored(d, kind, k, exact), "query_id long, vec_id long, score long")
            if best is not None:
                found = found.unionByName(best.select("query_id", "vec_id", "score"))
            best = _spark.written(found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k), "best")
            report.scored += seen.get["bytes"] // 8
            skip += take or len(got)
        shared.destroy()
    return best.select("query_id", "rank", "vec_id", "score") if best is not None else spark.createDataFrame([], none)
