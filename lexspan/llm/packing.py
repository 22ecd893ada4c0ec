"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

A document is its ids and an end id. Longer ones than a sequence are cut into pieces of full length,
the first of which may be shorter. Pieces are dealt evenly into groups of about `GROUP` pieces by a
hash of their place in the scan; each group is packed by several islands, which start from best-fit
orders, breed by injecting whole well-filled bins of one parent into the other, drop the bins that hold
doubles and best-fit the displaced pieces. After each round the elite of an island moves to the next
one; the best packing of all islands stays. An island stops when it meets the lower bound. Groups then
trade: each hands its least filled sequences (`TRADED` pieces at most) to a pool with others, which is
packed anew from that state, so it never gets worse; pools trade in the same way, `TRADES` times at most.
What stays empty is thus part of a sequence for each pool instead of each group.

Which pieces share a group depends on the files' layout; that every piece is placed once does not.

Defined results: null and empty texts are the end id alone; repeated rows are packed each for itself;
null doc_ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import _spark, _text, _tokens

LENGTH, GROUP, ISLANDS, ROUNDS, BROOD = 2048, 4096, 3, 2, 6
TRADED, TRADES = 96, 3


def _pieces(file: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                flat, off = _tokens.encode(file, some.column(1))
                cols: tuple[list, ...] = ([], [], [], [], [])
                for d, a, z in zip(some.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                    ids = np.concatenate((flat[a:z].astype("<u4"), end))
                    k = -(-len(ids) // length)
                    first = len(ids) - (k - 1) * length
                    raw = memoryview(ids.tobytes())
                    for p in range(k):
                        x = 0 if p == 0 else first + (p - 1) * length
                        y = first + p * length
                        for c, v in zip(cols, (d, p, x, y - x, zlib.crc32(raw[4 * x : 4 * y])), strict=True):
                            c.append(v)
                n = len(cols[0])
                place = (np.arange(seen, seen + n) + (part << 40)).astype(np.uint64)
                seen += n
                r = (_text.mix(place + np.uint64(77)) >> np.uint64(1)).astype(np.int64)
                yield pa.record_batch([*(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)), pa.array(r)], ["doc_id", "piece", "start", "length", "ids_crc32", "r"])

    return run


def best_fit(order, size: list[int], bin_of: list[int], free: dict[int, int] | list[int], length: int) -> int:
    """Puts the pieces of order into the open bin that they fill most, or a new one. free: room in each bin; gives the number of bins."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(free):
        if r > 0:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r
    n = len(free)
    for i in order:
        need = size[i]
        m = mask >> need
        if m:
            r = need + (m & -m).bit_length() - 1
            own = by_room[r]
            b = own.pop()
            if not own:
                mask ^= 1 << r
        else:
            b, r, n = n, length, n + 1
        bin_of[i] = b
        r -= need
        if r:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r
    return n


def _start(size: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    out = [0] * len(size)
    best_fit(order.tolist(), size.tolist(), out, [], length)
    return np.array(out, np.int32)


def fitness(size: np.ndarray, bins: np.ndarray, length: int) -> float:
    """Fewer bins first; among equals, unevenly filled ones."""
    fill = np.bincount(bins, size)
    return -len(fill) + float(np.mean((fill / length) ** 2))


def cross(size: np.ndarray, one: np.ndarray, two: np.ndarray, length: int, rng: np.random.Generator) -> np.ndarray:
    """A child of one that gets whole well-filled bins of two."""
    fill = np.bincount(two, size)
    well = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    given = rng.choice(well, max(1, len(well) // 3), replace=False)
    injected = np.isin(two, given)
    hurt = np.unique(one[injected])  # bins with doubles
    stay = ~np.isin(one, hurt)
    displaced = np.flatnonzero(~stay & ~injected)
    child = np.full(len(size), -1, np.int64)
    kept_bins, child_kept = np.unique(one[stay], return_inverse=True)
    child[stay] = child_kept
    _, new = np.unique(two[injected], return_inverse=True)
    child[injected] = new + len(kept_bins)
    n = len(kept_bins) + len(given)
    room = (length - np.bincount(child[child >= 0], size[child >= 0], n)).astype(int).tolist()
    bins = child.tolist()
    best_fit(displaced[np.argsort(-size[displaced], kind="stable")].tolist(), size.tolist(), bins, room, length)
    return np.array(bins, np.int32)


def evolve(size: np.ndarray, length: int, seed: int, elites: list[np.ndarray], brood: int = BROOD, starts: bool = False) -> np.ndarray:
    """The best packing that an island finds from the elites and, where there are none or with `starts`, its own best-fit orders."""
    rng = np.random.default_rng(seed)
    least = max(-(-int(size.sum()) // length), int((size * 2 > length).sum()))
    score = lambda b: fitness(size, b, length)
    herd = [(score(b), b) for b in elites]
    if starts or not herd:
        for spread in (0, 0.02, 0.1):
            if herd and max(herd, key=lambda x: x[0])[1].max() + 1 <= least:
                break
            keys = size * (1 + spread * rng.standard_normal(len(size)))
            b = _start(size, np.argsort(-keys, kind="stable"), length)
            herd.append((score(b), b))
    for _ in range(brood):
        herd.sort(key=lambda x: -x[0])
        if herd[0][1].max() + 1 <= least:
            break
        i, j = (0, 1 + int(rng.integers(len(herd) - 1))) if len(herd) > 1 else (0, 0)
        if rng.random() < 0.5:
            i, j = j, i
        b = cross(size, herd[i][1], herd[j][1], length, rng)
        if not any(x == (s := score(b)) and np.array_equal(y, b) for x, y in herd):
            herd = [*herd[:5], (s, b)]
    return max(herd, key=lambda x: x[0])[1]


def _island(length: int, seed: int, starts: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                size = np.frombuffer(r["sizes"], np.int32).astype(np.int64)
                elites = [np.frombuffer(x, np.int32) for x in (r["own"], r["guest"]) if x is not None]
                best = evolve(size, length, seed * 1000 + r["island"] * 31 + r["grp"] % 977, elites, starts=starts)
                yield pa.record_batch([pa.array([r["grp"]], pa.int64()), pa.array([r["island"]], pa.int32()), pa.array([r["sizes"]], pa.binary()), pa.array([best.astype(np.int32).tobytes()], pa.binary()), pa.array([fitness(size, best, length)])], ["grp", "island", "sizes", "own", "score"])

    return run


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sizes of each group's pieces as one value, and the sequences that they were in."""
    for batch in batches:
        for i in range(batch.num_rows):
            size = np.asarray(batch.column("sizes")[i].values.to_numpy(zero_copy_only=False), np.int32)
            was = batch.column("was")[i].values
            own = None if was.null_count else np.unique(was.to_numpy(), return_inverse=True)[1].astype(np.int32).tobytes()
            yield pa.record_batch([batch.column("grp").slice(i, 1), pa.array([size.tobytes()], pa.binary()), pa.array([own], pa.binary())], ["grp", "sizes", "own"])


_PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, grp long, open boolean"


def _open(size: np.ndarray, bins: np.ndarray, length: int) -> np.ndarray:
    """The pieces of the least filled sequences, TRADED at most."""
    fill, count = np.bincount(bins, size), np.bincount(bins)
    order = np.argsort(fill, kind="stable")
    order = order[fill[order] < length]
    taken = order[np.cumsum(count[order]) <= TRADED]
    return np.isin(bins, taken)


def _placed(length: int, level: int):
    """Each piece with its sequence and place in it; open: its sequence is traded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                g, bins = batch.column("grp")[i].as_py(), np.frombuffer(batch.column("own")[i].as_py(), np.int32)
                p = pa.RecordBatch.from_struct_array(batch.column("pieces")[i].values)
                size = p.column("length").to_numpy()
                order = np.lexsort((np.arange(len(bins)), bins))
                before = np.cumsum(size[order]) - size[order]
                new = np.concatenate(([True], np.diff(bins[order]) > 0))
                place = np.empty(len(bins), np.int64)
                place[order] = before - before[new][np.cumsum(new) - 1]
                more = [pa.array(bins.astype(np.int64) + (g << 24) + (level << 58)), pa.array(place), pa.array(np.full(len(bins), g)), pa.array(_open(size, bins, length))]
                yield pa.record_batch([p.column(c) for c in _PIECE] + more, [*_PIECE, "sequence_id", "offset", "grp", "open"])

    return run


def _evolved(groups: DataFrame, length: int, islands: int, rounds: int) -> DataFrame:
    """(grp, own): the sequence of each piece of a group. groups: grp, pieces with length and was, the sequence before, if any."""
    dealt = groups.select("grp", F.col("pieces.length").alias("sizes"), F.col("pieces.was").alias("was")).mapInArrow(_dealt, "grp long, sizes binary, own binary")
    state = dealt.select("grp", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes", "own", F.lit(None).cast("binary").alias("guest")).repartition("grp", "island")
    out = "grp long, island int, sizes binary, own binary, score double"
    state = _spark.written(state.mapInArrow(_spark.bounded(_island(length, 1, True)), out), "elites")
    for k in range(1, rounds):
        guest = state.select("grp", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("own").alias("guest"))
        state = _spark.written(state.join(guest, ["grp", "island"]).select("grp", "island", "sizes", "own", "guest").mapInArrow(_spark.bounded(_island(length, 1 + k)), out), "elites")
    return state.groupBy("grp").agg(F.max_by("own", F.struct("score", -F.col("island"))).alias("own"))


def pack(docs: DataFrame, file: str, end_id: int = 0, length: int = LENGTH, group: int = GROUP, islands: int = ISLANDS, rounds: int = ROUNDS, trades: int = TRADES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = _spark.written(slim.mapInArrow(_spark.bounded(_pieces(file, end_id, length)), "doc_id long, piece int, start long, length long, ids_crc32 long, r long"), "pieces")
    rows, deal, was, level, done = pieces, F.col("r"), F.lit(None).cast("long"), 0, []
    while True:
        n = max(1, -(-rows.count() // group))
        row = F.struct(*_PIECE, was.alias("was"))
        groups = _spark.written(rows.groupBy(F.pmod(deal, F.lit(n)).alias("grp")).agg(F.sort_array(F.collect_list(row)).alias("pieces")), "groups")
        placed = _spark.written(groups.join(_evolved(groups, length, islands, rounds), "grp").select("grp", "pieces", "own").mapInArrow(_spark.bounded(_placed(length, level)), _PLACED), "placed")
        if n == 1 or level == trades:
            done.append(placed)
            break
        done.append(placed.where("NOT open"))
        rows, deal, was, level = placed.where("open"), F.xxhash64("grp"), F.col("sequence_id"), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*_PIECE, "sequence_id", "offset")
