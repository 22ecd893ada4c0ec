"""State changes as set operations: leases, compare-and-set, upserts, outbox reports, intake, decisions, and a commit that readers see whole.

A batch of requests is judged against the state before it; of requests that exclude each other, the
first in order wins. Nothing is changed in place: each function gives the rows that a writer stores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from . import registry


def leased(leases: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """version_id, owner and outcome: acquired, renewed or busy.

    leases: version_id, owner, expires_at; requests: version_id, owner, requested_at. The owner of a live
    lease renews it; a free or expired one goes to the first request, by time and then by owner.
    """
    live = leases.where(F.col("expires_at") > now).select("version_id", F.col("owner").alias("_holder"))
    asked = requests.groupBy("version_id", "owner").agg(F.min("requested_at").alias("requested_at"))
    first = registry.latest(asked, "version_id", F.asc("requested_at"), F.asc("owner")).select("version_id", F.col("owner").alias("_first"))
    j = asked.join(live, "version_id", "left").join(first, "version_id")
    outcome = F.when(F.col("_holder") == F.col("owner"), "renewed").when(F.col("_holder").isNull() & (F.col("_first") == F.col("owner")), "acquired").otherwise("busy")
    return j.select("version_id", "owner", outcome.alias("outcome"))


def expires_at(at: Column, seconds: int) -> Column:
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def reported(outbox: DataFrame, reports: DataFrame) -> DataFrame:
    """publication_id, owner, outcome, state, attempts and wait_ms after reports of deliveries.

    outbox: publication_id, state, owner, attempts; reports: publication_id, owner, delivered. Only the owner
    of a row in delivery may report; a failed one is due again after a wait that doubles.
    """
    j = reports.join(outbox.withColumnRenamed("owner", "_owner"), "publication_id", "left")
    own = F.coalesce((F.col("state") == "delivering") & (F.col("_owner") == F.col("owner")), F.lit(False))
    failed = own & ~F.col("delivered")
    attempts = F.col("attempts") + F.when(failed, 1).otherwise(0)
    return j.select(
        "publication_id", "owner", F.when(~own, "refused").when(F.col("delivered"), "completed").otherwise("rescheduled").alias("outcome"),
        F.when(~own, F.col("state")).when(F.col("delivered"), "delivered").otherwise("pending").alias("state"), attempts.alias("attempts"), F.when(failed, T.backoff_ms(attempts)).alias("wait_ms"),
    )


def compare_and_set(current: DataFrame, proposals: DataFrame, key: str) -> DataFrame:
    """key, value, order and outcome (set or conflict). current: key, value; proposals: key, expected, value, order."""
    j = proposals.join(current.select(key, F.col("value").alias("_now")), key, "left")
    fits = F.col("expected").eqNullSafe(F.col("_now"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(fits.desc(), "order"))
    return j.withColumn("_won", fits & (first == 1)).select(key, "value", "order", F.when(F.col("_won"), "set").otherwise("conflict").alias("outcome"))


def upserted(stored: DataFrame, more: DataFrame, key: str, order: str) -> DataFrame:
    """Of equal keys the last in order, those of more after those stored."""
    rows = stored.withColumn("_late", F.lit(0)).unionByName(more.withColumn("_late", F.lit(1)))
    return registry.latest(rows, key, F.desc("_late"), F.desc(order)).drop("_late")


def inserted(stored: DataFrame, more: DataFrame, key: str, order: str) -> DataFrame:
    """Of equal keys the first in order; what is stored stays."""
    rows = stored.withColumn("_late", F.lit(0)).unionByName(more.withColumn("_late", F.lit(1)))
    return registry.latest(rows, key, F.asc("_late"), F.asc(order)).drop("_late")


def next_orders(rows: DataFrame, key: str, order: str = "append_order") -> DataFrame:
    """key, n and the order that the next row gets."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), (F.coalesce(F.max(order), F.lit(0)) + 1).alias("next_order"))


def intake(claims: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions to append, events, cursors) of the publications that are first or next for their source.

    claims: source_id, publication_id, claim; changes: publication_id, card_id, kind. An added or updated unit
    appends a version and validates it; a removed one disables its card.
    """
    due = claims.where(F.col("claim").isin("first", "next"))
    own = changes.join(due.select("publication_id"), "publication_id")
    versions = own.where("kind <> 'removed'").select("card_id", "publication_id")
    events = own.select("card_id", "publication_id", F.when(F.col("kind") == "removed", "disabled").otherwise("validated").alias("event"))
    return versions, events, due.select("source_id", F.col("publication_id").alias("cursor"))


def decided(versions: DataFrame, current: DataFrame, decisions: DataFrame) -> DataFrame:
    """card_id, version_id, action and outcome: the audit event, or why the decision is refused.

    versions: card_id, version_id, append_order; current: card_id, version_id; decisions: card_id, version_id,
    action. A rollback needs a version appended before the current one; a rejected one must not be current.
    """
    place = versions.select("card_id", "version_id", "append_order")
    now = current.join(place, ["card_id", "version_id"]).select("card_id", F.col("version_id").alias("_current"), F.col("append_order").alias("_at"))
    j = decisions.join(place, ["card_id", "version_id"], "left").join(now, "card_id", "left")
    is_current = F.coalesce(F.col("_current") == F.col("version_id"), F.lit(False))
    outcome = (
        F.when(F.col("append_order").isNull(), "unknown_version")
        .when(F.col("action") == "promote", F.when(is_current, "already_current").otherwise("promoted"))
        .when(F.col("action") == "rollback", F.when(F.col("append_order") < F.col("_at"), "rolled_back").otherwise("does_not_precede"))
        .when(F.col("action") == "reject", F.when(is_current, "is_current").otherwise("rejected"))
        .when(F.col("action") == "disable", F.when(F.col("_current").isNull(), "nothing_current").otherwise("disabled"))
        .otherwise("unknown_action")
    )
    return j.select("card_id", "version_id", "action", outcome.alias("outcome"))


SOURCE_STATES = ("unverified", "ready", "unavailable")


def source_states(events: DataFrame) -> DataFrame:
    """source_id, inspection, execution and lifecycle after a source's events, and how many could not apply.

    events: source_id, kind, append_order; kinds: inspected, failed_inspection, started, succeeded, failed,
    disabled, enabled. Each axis is set by its last event; a start counts only after a ready inspection and
    while the source is active.
    """
    w = Window.partitionBy("source_id").orderBy("append_order").rowsBetween(Window.unboundedPreceding, -1)
    inspection = F.when(F.col("kind") == "inspected", "ready").when(F.col("kind") == "failed_inspection", "unavailable")
    lifecycle = F.when(F.col("kind") == "disabled", "disabled").when(F.col("kind") == "enabled", "active")
    e = events.withColumns({"_i": inspection, "_l": lifecycle})
    e = e.withColumns({"_before": F.last("_i", ignorenulls=True).over(w), "_active": F.coalesce(F.last("_l", ignorenulls=True).over(w), F.lit("active"))})
    may = F.coalesce(F.col("_before") == "ready", F.lit(False)) & (F.col("_active") == "active")
    e = e.withColumn("_x", F.when(F.col("kind") == "started", F.when(may, "running")).when(F.col("kind").isin("succeeded", "failed"), F.col("kind")))
    last = lambda c, none: F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("append_order"))), F.lit(none))
    refused = F.count_if((F.col("kind") == "started") & ~may)
    return e.groupBy("source_id").agg(last("_i", "unverified").alias("inspection"), last("_x", "idle").alias("execution"), last("_l", "active").alias("lifecycle"), refused.alias("refused"))


class Commits:
    """Tables that change together: every commit is a folder of its own, and readers see only those with a marker, which is written last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def committed(self) -> list[str]:
        from pyspark.errors import AnalysisException

        try:
            return [r["commit_id"] for r in self.spark.read.parquet(f"{self.root}/markers").select("commit_id").distinct().orderBy("commit_id").collect()]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def commit(self, commit_id: str, **tables: DataFrame) -> str:
        """committed, or already_committed; a commit that failed half-way leaves no marker and is written again."""
        if commit_id in self.committed():
            return "already_committed"
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/commits/commit_id={commit_id}/{name}")
        marker = self.spark.createDataFrame([(commit_id, sorted(tables))], "commit_id string, tables array<string>")
        marker.coalesce(1).write.mode("append").parquet(f"{self.root}/markers")
        return "committed"

    def read(self, name: str) -> DataFrame | None:
        """The rows of a table over all commits."""
        has = self.committed() and self.spark.read.parquet(f"{self.root}/markers").where(F.array_contains("tables", name))
        at = [f"{self.root}/commits/commit_id={r['commit_id']}/{name}" for r in has.select("commit_id").distinct().collect()] if has else []
        return self.spark.read.parquet(*at) if at else None
