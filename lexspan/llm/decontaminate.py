"""Benchmark decontamination: word windows of benchmark items are looked up in documents.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is `n` consecutive
words of an item; an item with fewer words, but not none, is one window. The windows' hashes are a
broadcast set of about `most` windows. A larger benchmark is split by hash into sets of that size: the
documents are then written with row numbers, each set is scanned by a job of its own, its hits are
written and its broadcast destroyed before the next, and the hits of each row are put together. Every
hash hit is verified on the words themselves.

Defined results: null or empty texts have no words and no hits; items with a null id count as hits but
not among the items; rows are judged and cut each by its own text, whatever its doc_id, so repeated rows
give repeated results and rows without a doc_id go like others; an empty benchmark hits nothing; an
empty table gives no rows; other columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import _spark, _text

N_WORDS, MOST_WINDOWS = 10, 250_000
_SPAN = StructType([StructField("first", IntegerType()), StructField("past", IntegerType())])


def _item_windows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size, key, text = [], [], [], []
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                buf, _ = _text.join(pa.array([body.as_py()], pa.string()))
                a, z, h = _text.all_words(buf, _text.alnum)
                m = min(n, len(a))
                if not m:
                    continue
                low = _text.lower(buf).tobytes()
                w = [low[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)]
                for i, x in enumerate(_text.window_hashes(h, m).view(np.int64).tolist()):
                    ids.append(item)
                    size.append(m)
                    key.append(x)
                    text.append(b" ".join(w[i : i + m]))
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(size, pa.int32()), pa.array(key, pa.int64()), pa.array(text, pa.binary())], ["item", "size", "key", "words"])

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], y))
        else:
            out.append((x, y))
    return out


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))


def _scan(shared):
    """For each text: its number of words, the word ranges that windows cover, and the items."""

    def run(batches: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        windows: dict[bytes, list[str | None]] = shared.value[1]
        sizes = []
        for m, keys in shared.value[0].items():
            bits = np.zeros(1 << 22, bool)
            bits[(keys >> np.uint64(42)).astype(np.int64)] = True
            sizes.append((m, np.sort(keys), bits))
        for texts in batches:
            buf_all, start_all = _text.join(texts)
            n = len(texts)
            n_words = np.zeros(n, np.int64)
            hits: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
            for i, j in _text.slices(start_all):
                buf, start = buf_all[start_all[i] : start_all[j]], start_all[i : j + 1] - start_all[i]
                a, z, h = _text.all_words(buf, _text.alnum)
                first = np.searchsorted(a, start)
                count = np.diff(first)
                n_words[i:j] = count
                doc = np.repeat(np.arange(j - i), count)
                for m, keys, bits in sizes:
                    w = _text.window_hashes(h, m)
                    at = np.flatnonzero(bits[(w >> np.uint64(42)).astype(np.int64)])
                    if not len(at):
                        continue
                    place = np.minimum(np.searchsorted(keys, w[at]), len(keys) - 1)
                    at = at[(keys[place] == w[at]) & (doc[at] == doc[at + m - 1])]
                    for k in at.tolist():
                        found = windows.get(b" ".join([_text.lower(buf[a[x] : z[x]]).tobytes() for x in range(k, k + m)]))
                        if found is None:
                            continue
                        d = int(doc[k])
                        spans, names = hits.setdefault(i + d, ([], set()))
                        p = k - int(first[d])
                        if spans and spans[-1][0] <= p <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(spans[-1][1], p + m))
                        else:
                            spans.append((p, p + m))
                        names.update(x for x in found if x is not None)
            rows = [hits.get(i, ([], ())) for i in range(n)]
            spans = [[{"first": x, "past": y} for x, y in _merged(r[0])] for r in rows]
            yield [pa.array(n_words), pa.array(spans, _SPANS), pa.array([sorted(r[1]) for r in rows], pa.list_(pa.string()))]

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans that several sets found in a row as one list."""
    for batch in batches:
        found = [_merged([(s["first"], s["past"]) for own in r for s in own]) for r in batch.column("spans").to_pylist()]
        items = [sorted({x for own in r for x in own}) for r in batch.column("items").to_pylist()]
        yield pa.record_batch([batch.column("row"), pa.array([[{"first": x, "past": y} for x, y in r] for r in found], _SPANS), pa.array(items, pa.list_(pa.string()))], ["row", "spans", "items"])


def _found(docs: DataFrame, benchmark: DataFrame, n: int, most: int | None) -> DataFrame:
    """docs with its columns as c0, c1, ..., and of each text: _x0 its number of words, _x1 the covered ranges of words, _x2 the items."""
    spark = docs.sparkSession
    windows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(_spark.bounded(_item_windows(n)), "item string, size int, key long, words binary")
    windows = _spark.written(windows.groupBy("size", "key", "words").agg(F.collect_set("item").alias("items")), "windows")
    parts = max(1, -(-windows.count() // (most or MOST_WINDOWS)))
    fields = [StructField("n", LongType()), StructField("spans", ArrayType(_SPAN)), StructField("items", ArrayType(StringType()))]

    def sent(p: int):
        keys: dict[int, list[int]] = {}
        names: dict[bytes, list[str]] = {}
        for r in windows.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == p).toLocalIterator():  # about `most` rows
            keys.setdefault(r["size"], []).append(r["key"])
            names[bytes(r["words"])] = r["items"]
        return spark.sparkContext.broadcast(({m: np.unique(np.array(k, np.int64)).view(np.uint64) for m, k in keys.items()}, names))

    if parts == 1:
        return _spark.appended(docs, "text", _scan(sent(0)), fields)
    own = [f"c{i}" for i in range(len(docs.columns))]
    numbered = _spark.written(docs.toDF(*own).withColumn("row", F.monotonically_increasing_id()), "numbered")
    texts, hits = numbered.select("row", F.col(f"c{docs.columns.index('text')}").alias("text")), None
    for p in range(parts):
        shared = sent(p)
        scanned = _spark.appended(texts, "text", _scan(shared), fields).select(F.col("c0").alias("row"), F.col("_x0").alias("n"), F.col("_x1").alias("spans"), F.col("_x2").alias("items"))
        # the first set's rows tell the number of words of every text
        some = _spark.written(scanned if not p else scanned.where(F.size("spans") > 0), "hits")
        shared.destroy()
        if not p:
            sizes = some.select("row", "n")
            some = some.where(F.size("spans") > 0)
        some = some.select("row", "spans", "items")
        hits = some if hits is None else hits.unionAll(some)
    gathered = hits.groupBy("row").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))  # `parts` lists at most
    merged = gathered.mapInArrow(_spark.bounded(_joined), StructType([StructField("row", LongType()), *fields[1:]]))
    whole = numbered.join(sizes, "row").join(merged, "row", "left")
    return whole.select(*own, F.col("n").alias("_x0"), F.coalesce("spans", F.array().cast(fields[1].dataType)).alias("_x1"), F.coalesce("items", F.array().cast(fields[2].dataType)).alias("_x2"))


def _hit():
    """The number of words in the covered ranges."""
    return F.aggregate("_x1", F.lit(0).cast("long"), lambda s, x: s + (x["past"] - x["first"]))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, most: int = MOST_WINDOWS) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items."""
    found = _found(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, n, most).withColumn("hit", _hit())
    digest = F.sha2(F.array_join(F.array_sort("_x2"), ",").cast("binary"), 256)
    return found.select(
        F.col("c0").cast("long").alias("doc_id"), F.col("_x0").alias("n_words"), F.col("hit").alias("n_hit"), F.size("_x2").cast("long").alias("n_items"), digest.alias("items_sha256"),
        (F.col("hit") > 0).alias("contaminated"), F.col("_x1").alias("spans"), F.col("_x2").alias("items"),
    )


def _cut(text: str | None, spans: list[dict] | None) -> str | None:
    if text is None or not spans:
        return text
    buf, _ = _text.join(pa.array([text], pa.string()))
    a, z, _ = _text.all_words(buf, _text.alnum)
    raw, at, kept = text.encode(), 0, []
    for s in spans:
        kept.append(raw[at : int(a[s["first"]])])
        at = int(z[s["past"] - 1])
    return b"".join([*kept, raw[at:]]).decode()


def _cut_out(place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_cut(t, s) for t, s in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return run


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "documents", n: int = N_WORDS, share: float = 0.0, most: int | None = None) -> DataFrame:
    """docs without contaminated documents (those with more than `share` of their words hit), or without the hit spans of words.

    Each row is judged and cut by its own text, whatever its doc_id: rows that share one or have none included.
    """
    if what not in ("documents", "spans"):
        raise ValueError(f"what: documents or spans, not {what}")
    own, place = [f"c{i}" for i in range(len(docs.columns))], docs.columns.index("text")
    found = _found(docs, benchmark, n, most)
    bad = (_hit() > 0) & (_hit() > F.lit(share) * F.col("_x0"))
    if what == "documents":
        return found.where(~bad).select(*own).toDF(*docs.columns)
    kinds = StructType([StructField(c, f.dataType) for c, f in zip(own, docs.schema.fields, strict=True)])
    return found.select(*own, F.when(bad, F.col("_x1")).alias("_spans")).mapInArrow(_spark.bounded(_cut_out(place)), kinds).toDF(*docs.columns)
