"""Publishing an index version: lease, difference from what is staged, missing records, verification, and one pointer row.

An intent is written before anything else, so a publication that stopped half-way is found and finished; every
step can be repeated. Records are compared as sets and never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import checks, state
from . import store

_INTENT = "document_index_id string, index_version string, owner string, n long, digest long"


def _digest(records: DataFrame) -> tuple[int, int]:
    """(number, sum of hashes) of records: the same for the same set in any order."""
    r = records.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*sorted(records.columns)).cast("decimal(38,0)")), F.lit(0)) % (1 << 62)).first()
    return int(r[0]), int(r[1])


class Publisher:
    def __init__(self, at: store.Store, owner: str):
        self.store, self.owner, self.spark = at, owner, at.spark

    def _append(self, name: str, row: tuple, schema: str) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(self.store._at(name))

    def _read(self, name: str, schema: str) -> DataFrame:
        found = self.store._read(name)
        return self.spark.createDataFrame([], schema) if found is None else found

    def lease(self, index_id: str, version: str, now: Column, seconds: int = 300) -> str:
        """acquired, renewed or busy; an acquired or renewed lease is written."""
        schema = "version_id string, owner string, expires_at timestamp"
        key = f"{index_id}/{version}"
        held = self._read("leases", schema).where(F.col("version_id") == key).groupBy("version_id").agg(F.max_by("owner", "expires_at").alias("owner"), F.max("expires_at").alias("expires_at"))
        asked = self.spark.createDataFrame([(key, self.owner)], "version_id string, owner string").withColumn("requested_at", now)
        outcome = state.leased(held, asked, now).first()["outcome"]
        if outcome != "busy":
            row = self.spark.createDataFrame([(key, self.owner)], "version_id string, owner string").withColumn("expires_at", state.expires_at(now, seconds))
            row.coalesce(1).write.mode("append").parquet(self.store._at("leases"))
        return outcome

    def stage(self, index_id: str, version: str, records: DataFrame) -> int:
        """Writes the records that the staged version lacks; foreign or different ones refuse it. Gives the number written."""
        at = ("records", f"document_index_id={index_id}", f"index_version={version}")
        staged, key = self.store._read(*at), "record_id"
        if staged is None:
            records.write.mode("append").parquet(self.store._at(*at))
            return records.count()
        fields = [c for c in records.columns if c != key]
        needs = checks.staged_differences(staged, records, key, fields)
        if not needs.where("need <> 'missing'").isEmpty():
            raise ValueError(f"version {version} is staged with other records")
        missing = records.join(needs, key, "left_semi")
        n = missing.count()
        if n:
            missing.write.mode("append").parquet(self.store._at(*at))
        return n

    def publish(self, index_id: str, version: str, records: DataFrame, now: Column, stop_before_pointer: bool = False) -> str:
        """published, already_published or busy. stop_before_pointer leaves an intent for recover(), as a crash would."""
        if self.lease(index_id, version, now) == "busy":
            return "busy"
        current = {r["document_index_id"]: r["index_version"] for r in self.store.current().where(F.col("document_index_id") == index_id).collect()}
        n, digest = _digest(records)
        self._append("intents", (index_id, version, self.owner, n, digest), _INTENT)
        self.stage(index_id, version, records)
        if stop_before_pointer:
            return "staged"
        if current.get(index_id) == version:
            return "already_published"
        return self._point(index_id, version, n, digest)

    def _point(self, index_id: str, version: str, n: int, digest: int) -> str:
        stored = self.store._read("records", f"document_index_id={index_id}", f"index_version={version}")
        if stored is None or _digest(stored) != (n, digest):
            raise RuntimeError(f"the staged version {version} is not what was intended")
        return self.store.point(index_id, version)

    def recover(self) -> list[tuple[str, str]]:
        """Finishes intents whose version is staged whole and was never pointed to; gives them."""
        pointed = self._read("pointers", "document_index_id string, index_version string, order long").select("document_index_id", "index_version")
        out = []
        for r in self._read("intents", _INTENT).join(pointed, ["document_index_id", "index_version"], "left_anti").distinct().orderBy("document_index_id", "index_version").collect():  # unfinished ones only
            stored = self.store._read("records", f"document_index_id={r['document_index_id']}", f"index_version={r['index_version']}")
            if stored is not None and _digest(stored) == (r["n"], r["digest"]):
                self.store.point(r["document_index_id"], r["index_version"])
                out.append((r["document_index_id"], r["index_version"]))
        return out


def reindexed(chunks: DataFrame, stored: DataFrame, **how) -> DataFrame:
    """record_id, digest, embedding and origin of a new version: vectors of unchanged chunks are harvested from the stored one, others are made.

    chunks: record_id, digest, text; stored: record_id, digest, embedding.
    """
    key = ["record_id", "digest"]
    kept = chunks.select(*key).join(stored.select(*key, "embedding"), key).withColumn("origin", F.lit("reused"))
    fresh = store.embedded(chunks.join(stored.select(*key), key, "left_anti"), **how).select(*key, "embedding").withColumn("origin", F.lit("embedded"))
    return kept.unionByName(fresh)
