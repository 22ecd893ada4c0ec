"""Quality measures of retrieval, segmentation and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def retrieval_quality(hits: DataFrame) -> DataFrame:
    """n_queries, recall_at_5, mrr_at_10. hits: query_id, id, score, relevant."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    first = hits.withColumn("r", F.row_number().over(w)).groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("r"))).alias("first"))
    hit = lambda k, v: F.round(F.avg(F.when(F.col("first") <= k, v).otherwise(0.0)), 9)
    return first.agg(F.count("*").alias("n_queries"), hit(5, F.lit(1.0)).alias("recall_at_5"), hit(10, 1.0 / F.col("first")).alias("mrr_at_10"))


def boundary_quality(gaps: DataFrame, window: int) -> DataFrame:
    """For each doc_id: precision, recall, f1, pk, window_diff. gaps: doc_id, at (from 0), expected, predicted (0 or 1)."""
    w = Window.partitionBy("doc_id").orderBy("at").rowsBetween(0, window - 1)
    full = F.count("*").over(w) == window
    g = gaps.withColumn("_e", F.when(full, F.sum("expected").over(w))).withColumn("_p", F.when(full, F.sum("predicted").over(w)))
    both, n_p, n_e = F.sum(F.col("expected") * F.col("predicted")), F.sum("predicted"), F.sum("expected")
    a = g.groupBy("doc_id").agg(
        both.alias("tp"), n_p.alias("np"), n_e.alias("ne"), F.avg(F.when(F.col("_e").isNotNull(), ((F.col("_e") > 0) != (F.col("_p") > 0)).cast("double"))).alias("pk"), F.avg(F.when(F.col("_e").isNotNull(), (F.col("_e") != F.col("_p")).cast("double"))).alias("window_diff")
    )
    p = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(F.when(F.col("ne") == 0, 1.0).otherwise(0.0))
    r = F.when(F.col("ne") > 0, F.col("tp") / F.col("ne")).otherwise(F.when(F.col("np") == 0, 1.0).otherwise(0.0))
    return a.select("doc_id", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), F.coalesce("pk", F.lit(0.0)).alias("pk"), F.coalesce("window_diff", F.lit(0.0)).alias("window_diff"))


def selection_quality(judgements: DataFrame) -> DataFrame:
    """By category and over all: top-1 accuracy, wrong-admit ratio, forbidden admits, margin, and the share of each verdict.

    judgements: query_id, category, version_id, score, verdict, wanted (required, optional, forbidden or null).
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "version_id")
    j = judgements.withColumn("r", F.row_number().over(w)).withColumn("margin", F.col("score") - F.lead("score").over(w))
    j.createOrReplaceTempView("_selection_judgements")
    return j.sparkSession.sql("""
SELECT coalesce(category, 'all') AS category, round(avg(CASE WHEN r = 1 THEN CAST(coalesce(wanted = 'required', false) AS DOUBLE) END), 9) AS top1,
  round(count_if(verdict = 'admit' AND coalesce(wanted, 'none') NOT IN ('required', 'optional')) / nullif(count_if(verdict = 'admit'), 0), 9) AS wrong_admits,
  count_if(verdict = 'admit' AND wanted = 'forbidden') AS forbidden_admits, round(median(CASE WHEN r = 1 THEN margin END), 9) AS margin_median,
  round(count_if(verdict = 'admit') / count(*), 9) AS admit_share, round(count_if(verdict = 'defer') / count(*), 9) AS defer_share, round(count_if(verdict = 'reject') / count(*), 9) AS reject_share
FROM _selection_judgements GROUP BY GROUPING SETS ((category), ())""")
