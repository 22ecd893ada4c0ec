"""The change feed as a stream: publications arrive in any order and are taken in chain order, once each.

State is held for each source: its cursor and the publications that wait for their predecessor, at most
`MOST_WAITING`. A publication that was seen is dropped; one whose predecessor is missing waits and is
reported as deferred; one that follows neither the cursor nor nothing is a fork, which stops its source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST_WAITING = 10_000
FEED = "source_id long, publication_id long, previous_id long"
OUT = "source_id long, publication_id long, outcome string, position long"
_STATE = "cursor long, position long, forked boolean, ids array<long>, previous array<long>"


def take(cursor: int | None, position: int, forked: bool, waiting: dict[int, int | None], arrived: list[tuple[int, int | None]]):
    """One step of a source: (cursor, position, forked, waiting, [(publication, outcome, position)])."""
    out: list[tuple[int, str, int | None]] = []
    fresh = set()
    for p, before in arrived:
        if p not in waiting and p != cursor:
            waiting[p] = before
            fresh.add(p)
    while not forked:
        nexts = sorted(p for p, before in waiting.items() if before == cursor)
        if not nexts:
            break
        p = nexts[0]
        del waiting[p]
        position += 1
        out.append((p, "first" if cursor is None else "next", position))
        cursor = p
        for other in nexts[1:]:
            forked = True
            out.append((other, "fork", None))
            del waiting[other]
    if len(waiting) > MOST_WAITING:
        raise RuntimeError(f"over {MOST_WAITING} publications of a source wait for their predecessor")
    out += [(p, "deferred", None) for p in sorted(fresh & waiting.keys())]
    return cursor, position, forked, waiting, out


def _source(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    cursor, position, forked, waiting = None, 0, False, {}
    if state.exists:
        cursor, position, forked, ids, previous = state.get
        waiting = dict(zip(ids, [None if x == -1 else x for x in previous], strict=True))
        cursor = None if cursor == -1 else cursor
    arrived = []
    for f in frames:
        arrived += [(int(p), None if pd.isna(b) else int(b)) for p, b in zip(f["publication_id"], f["previous_id"], strict=True)]
    arrived.sort()
    cursor, position, forked, waiting, out = take(cursor, position, forked, waiting, arrived)
    ids = sorted(waiting)
    state.update((-1 if cursor is None else cursor, position, forked, ids, [-1 if waiting[i] is None else waiting[i] for i in ids]))
    if out:
        yield pd.DataFrame({"source_id": key[0], "publication_id": [x[0] for x in out], "outcome": [x[1] for x in out], "position": pd.array([x[2] for x in out], "Int64")})


def in_chain_order(publications: DataFrame) -> DataFrame:
    """A streaming frame of FEED rows as OUT rows."""
    return publications.groupBy("source_id").applyInPandasWithState(_source, OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Takes all that has arrived, batch by batch, and stops; sink must be idempotent by batch number."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return q


def windowed_counts(events: DataFrame, late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by event-time window, for late data up to a watermark; batch or stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
