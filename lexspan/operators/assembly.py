"""Context assembly: quarantine, reciprocal-rank fusion, removal of repeats, budget, response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MOST_UNITS, MOST_CHUNKS, K = 8000, 12, 60


def quarantined(candidates: DataFrame) -> DataFrame:
    """(query_id, target) of targets that contradict others: one revision with two digests or one digest with two lengths.

    A group that disagrees loses all its targets, and what is left of other groups still agrees, so one pass is enough.
    """
    def differs(key: str, what: Column) -> Column:
        w = Window.partitionBy("query_id", key)
        return F.min(what).over(w) != F.max(what).over(w)

    seen = candidates.withColumn("_r", differs("revision", F.struct("digest", "units"))).withColumn("_d", differs("digest", F.col("units")))
    return seen.where("_r OR _d").select("query_id", "target").distinct()


def sound(outcomes: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, target) of outcomes whose ranks run from 1 without gaps, within the limit, over different revisions."""
    a = outcomes.groupBy("query_id", "target").agg(F.count("*").alias("n"), F.max("rank").alias("top"), F.count_distinct("rank").alias("ranks"), F.count_distinct("revision").alias("revisions"))
    return a.where((F.col("n") <= limit) & (F.col("top") == F.col("n")) & (F.col("ranks") == F.col("n")) & (F.col("revisions") == F.col("n"))).select("query_id", "target")


def fused(candidates: DataFrame, k: int = K) -> DataFrame:
    """One row for each revision: the sum of reciprocals, added in a fixed order, and its best occurrence (rank, target, item).

    candidates: query_id, target, item, rank, revision, digest, units.
    """
    occurrence = F.struct("rank", "target", "item", "digest", "units")
    g = candidates.groupBy("query_id", "revision").agg(F.array_sort(F.collect_list(occurrence)).alias("_o"))  # as many as a query has targets
    score = F.aggregate("_o", F.lit(0.0), lambda s, x: s + F.lit(1.0) / (k + x["rank"]))
    best = F.element_at("_o", 1)
    return g.select("query_id", "revision", score.alias("score"), F.size("_o").alias("occurrences"), best["rank"].alias("rank"), best["target"].alias("target"), best["item"].alias("item"), best["digest"].alias("digest"), best["units"].alias("units"))


def kept(fusion: DataFrame, most_units: int = MOST_UNITS, most_chunks: int = MOST_CHUNKS) -> DataFrame:
    """fusion with outcome: kept, duplicate_content or budget_exhausted, and context_rank of those kept.

    Of equal contents the first stays. The budget stops at the first chunk that does not fit; the running
    sum only grows, so a bound on it and on the place says the same.
    """
    order = [F.desc("score"), "rank", "target", "revision"]
    f = fusion.withColumn("_copy", F.row_number().over(Window.partitionBy("query_id", "digest").orderBy(*order)))
    f = f.withColumn("_live", (F.col("_copy") == 1).cast("int"))
    w = Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("_units", F.sum(F.col("units") * F.col("_live")).over(w)).withColumn("_place", F.sum("_live").over(w))
    fits = (F.col("_units") <= most_units) & (F.col("_place") <= most_chunks)
    out = F.when(F.col("_live") == 0, "duplicate_content").when(fits, "kept").otherwise("budget_exhausted")
    return f.withColumn("outcome", out).withColumn("context_rank", F.when(out == "kept", F.col("_place").cast("int"))).drop("_copy", "_live", "_units", "_place")


def narrowed(configured: int, requested: int | None) -> int:
    """A request may only lower the budget."""
    if requested is not None and not 0 < requested <= configured:
        raise ValueError("a request may only lower the budget")
    return configured if requested is None else requested


def response(plan: DataFrame, outcomes: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each planned item with its status (delegated, failed or fulfilled), its chunks in order, and whether the budget cut it.

    plan: query_id, item, target, managed; outcomes: query_id, target, status; chunks: kept().
    """
    own = chunks.groupBy("query_id", "item").agg(
        F.array_sort(F.collect_list(F.when(F.col("outcome") == "kept", F.struct("context_rank", "revision")))).alias("chunks"), F.bool_or(F.col("outcome") == "budget_exhausted").alias("truncated")
    )
    joined = plan.join(outcomes, ["query_id", "target"], "left").join(own, ["query_id", "item"], "left")
    status = F.when(~F.col("managed"), "delegated").when(F.coalesce(F.col("status"), F.lit("failed")) == "fulfilled", "fulfilled").otherwise("failed")
    return joined.select("query_id", "item", status.alias("status"), "chunks", F.coalesce("truncated", F.lit(False)).alias("truncated"))
