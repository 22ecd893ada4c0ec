"""Vector index store: partitioned tables of immutable versions, staged, verified and then pointed to.

A version is written to its own folder, compared with what was intended, and becomes current by one
small pointer row; readers see the old version or the new one, never a part. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType


class Store:
    """Index versions under a root folder, one collection for each compatibility digest."""

    def __init__(self, spark: SparkSession, root: str, compatibility: str):
        self.spark, self.root, self.compatibility = spark, root.rstrip("/"), compatibility

    def _at(self, *parts: str) -> str:
        return "/".join([self.root, f"compatibility={self.compatibility}", *parts])

    def _read(self, *parts: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(self._at(*parts))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def publish(self, index_id: str, version: str, records: DataFrame) -> str:
        """Writes a version and makes it current; gives published or already_published, and refuses other records under the same version."""
        stored = self._read("records", f"document_index_id={index_id}", f"index_version={version}")
        if stored is not None:
            same = stored.select(*sorted(records.columns)).exceptAll(records.select(*sorted(records.columns))).isEmpty() and records.select(*sorted(records.columns)).exceptAll(stored.select(*sorted(records.columns))).isEmpty()
            if not same:
                raise ValueError(f"version {version} exists with other records")
            state = "already_published"
        else:
            records.write.parquet(self._at("records", f"document_index_id={index_id}", f"index_version={version}"))
            written = self.spark.read.parquet(self._at("records", f"document_index_id={index_id}", f"index_version={version}"))
            if written.count() != records.count():
                raise RuntimeError("the staged version is not complete")
            state = "published"
        self.point(index_id, version)
        return state

    def point(self, index_id: str, version: str) -> str:
        """Makes a stored version the current one."""
        n = self._read("pointers")
        order = 0 if n is None else (n.where(F.col("document_index_id") == index_id).agg(F.max("order")).first()[0] or 0) + 1
        self.spark.createDataFrame([(index_id, version, order)], "document_index_id string, index_version string, order long").coalesce(1).write.mode("append").parquet(self._at("pointers"))
        return "published"

    def current(self) -> DataFrame:
        """document_index_id and its current index_version."""
        p = self._read("pointers")
        if p is None:
            return self.spark.createDataFrame([], "document_index_id string, index_version string")
        w = Window.partitionBy("document_index_id").orderBy(F.desc("order"))
        return p.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("document_index_id", "index_version")

    def records(self, condition: Column | None = None) -> DataFrame:
        """Records of all versions; a condition on index and version reads only their folders."""
        r = self.spark.read.parquet(self._at("records"))
        return r if condition is None else r.where(condition)

    def vectors(self, revisions: DataFrame) -> DataFrame:
        return self.records().join(revisions.select("chunk_revision_id").distinct(), "chunk_revision_id", "left_semi").select("chunk_revision_id", "embedding")


def upserted(stored: DataFrame, more: DataFrame, key: str = "record_id") -> DataFrame:
    """stored with more: of equal keys, the new one."""
    return stored.join(more.select(key), key, "left_anti").unionByName(more)


def deletable(versions: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    """Versions without a live lease (expires_at after now)."""
    return versions.join(leases.where(F.col("expires_at") > now).select("index_version"), "index_version", "left_anti")


def deterministic_vector(seed: str, dimensions: int) -> np.ndarray:
    """A unit vector from the bytes of SHA-256 of the seed and a counter."""
    import hashlib

    raw = b"".join(hashlib.sha256(f"{seed}\x00{i}".encode()).digest() for i in range(-(-dimensions // 32)))[:dimensions]
    v = np.frombuffer(raw, np.uint8).astype(float) / 127.5 - 1
    n = np.linalg.norm(v)
    return v / n if n else v


def embedded(rows: DataFrame, text: str = "text", model: str = "deterministic-v1", dimensions: int = 64, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """rows with embedding, made batch by batch; embed is any provider, which a worker calls with its texts."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.fillna("").tolist()
            out = embed(texts) if embed else [deterministic_vector(f"{model}\x00{t}", dimensions).tolist() for t in texts]
            if len(out) != len(texts):
                raise ValueError("an embedding provider must give one vector a text")
            yield pd.Series(out)

    return rows.withColumn("embedding", run(F.col(text)))


def embed_new(chunks: DataFrame, cache: DataFrame, **how) -> DataFrame:
    """chunk_revision_id, digest, embedding: from the cache where revision and digest are known, made otherwise."""
    key = ["chunk_revision_id", "digest"]
    reused = chunks.select(*key).join(cache.select(*key, "embedding"), key)
    fresh = embedded(chunks.join(cache.select(*key), key, "left_anti"), **how).select(*key, "embedding")
    return reused.unionByName(fresh)
