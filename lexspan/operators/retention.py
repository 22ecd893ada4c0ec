"""Retention of observations, the outbox, and clean-up of staged indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KEEP, DAYS, BATCH = 2, 7, 100
GRACE_HOURS, LEASE_SECONDS = 24, 300


def removable(observations: DataFrame, now: Column, *protected: DataFrame, keep: int = KEEP, days: int = DAYS) -> DataFrame:
    """Observations beyond the newest `keep` of their source, older than `days`, and in none of the protected sets (observation_id)."""
    w = Window.partitionBy("source_id").orderBy(F.desc("captured_at"), F.desc("observation_id"))
    out = observations.withColumn("_r", F.row_number().over(w)).where((F.col("_r") > keep) & (F.col("captured_at") < now - F.expr(f"INTERVAL {days} DAYS"))).drop("_r")
    for p in protected:
        out = out.join(p.select("observation_id"), "observation_id", "left_anti")
    return out


def due(outbox: DataFrame, now: Column) -> DataFrame:
    """Pending rows whose time has come, and rows whose delivery lease has run out."""
    return outbox.where(((F.col("state") == "pending") & (F.col("next_attempt_at") <= now)) | ((F.col("state") == "delivering") & (F.col("lease_expires_at") <= now)))


def claim_batch(outbox: DataFrame, now: Column, size: int = 25) -> DataFrame:
    """The next rows to deliver, oldest first: a batch, as the outbox hands them out."""
    return due(outbox, now).orderBy("next_attempt_at", "publication_id").limit(size)


def staging_outcomes(attempts: DataFrame, referenced: DataFrame, now: Column) -> DataFrame:
    """index_version and outcome: active (too new or leased), referenced, or deleted."""
    old = (F.col("created_at") < now - F.expr(f"INTERVAL {GRACE_HOURS} HOURS")) & ((F.col("state") == "pending") | F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now))
    r = referenced.select("index_version", F.lit(True).alias("_ref")).distinct()
    return attempts.join(r, "index_version", "left").select("index_version", F.when(~old, "active").when(F.coalesce("_ref", F.lit(False)), "referenced").otherwise("deleted").alias("outcome"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
