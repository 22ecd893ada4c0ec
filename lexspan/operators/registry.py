"""Registry of cards: versions, publication chains, impact of changes, reachability, lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

STATES = ("pending_registry", "broken", "reachable", "pending_approval", "intentionally_unexposed", "orphaned")
STALE_MS = 5 * 60 * 1000


def latest(rows: DataFrame, key: list[str] | str, *order: Column) -> DataFrame:
    """One row for each key: the first in that order. Spark keeps one a key before anything is moved."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def current_versions(versions: DataFrame) -> DataFrame:
    """The last appended version of each card."""
    return latest(versions, "card_id", F.desc("append_order"))


def approved_catalog(cards: DataFrame, versions: DataFrame) -> DataFrame:
    """Cards with their current version, in append order of the versions."""
    return cards.where(F.col("current_version_id").isNotNull()).join(versions.withColumnRenamed("version_id", "current_version_id"), ["card_id", "current_version_id"])


def chained(publications: DataFrame) -> DataFrame:
    """publications (source_id, publication_id, produced_at) with the previous one of each source."""
    w = Window.partitionBy("source_id").orderBy("produced_at", "publication_id")
    return publications.withColumn("previous_id", F.lag("publication_id").over(w))


def claims(publications: DataFrame, processed: DataFrame, cursors: DataFrame) -> DataFrame:
    """publication_id and claim: already_claimed, first, next, deferred (a gap) or fork.

    publications: source_id, publication_id, previous_id; processed: publication_id; cursors: source_id, cursor.
    """
    done = processed.select("publication_id", F.lit(True).alias("_done"))
    before = processed.select(F.col("publication_id").alias("previous_id"), F.lit(True).alias("_before"))
    j = publications.join(done, "publication_id", "left").join(before, "previous_id", "left").join(cursors, "source_id", "left")
    claim = (
        F.when(F.col("_done"), "already_claimed")
        .when(F.col("previous_id").isNull() & F.col("cursor").isNull(), "first")
        .when(F.col("previous_id") == F.col("cursor"), "next")
        .when(F.col("previous_id").isNull() | F.col("_before"), "fork")
        .otherwise("deferred")
    )
    return j.select("publication_id", claim.alias("claim"))


def delta(previous: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, kind (added, updated, removed), changed_fields, for what differs between two snapshots."""
    p = previous.select(key, F.struct(*fields).alias("_p"))
    c = current.select(key, F.struct(*fields).alias("_c"))
    j = p.join(c, key, "full")
    changed = F.filter(F.array(*[F.when(~F.col(f"_p.{f}").eqNullSafe(F.col(f"_c.{f}")), F.lit(f)) for f in sorted(fields)]), lambda x: x.isNotNull())
    kind = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "removed").when(F.size(changed) > 0, "updated")
    out = j.select(key, kind.alias("kind"), F.when(kind == "updated", changed).otherwise(F.array().cast("array<string>")).alias("changed_fields"))
    return out.where(F.col("kind").isNotNull())


def transition_violations(previous: DataFrame, current: DataFrame, declared: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of the true delta that are not declared, and declared ones that are not true."""
    true = delta(previous, current, key, fields).select(key, "kind", F.array_join("changed_fields", ",").alias("fields"))
    said = declared.select(key, "kind", F.array_join("changed_fields", ",").alias("fields"))
    return true.exceptAll(said).withColumn("problem", F.lit("undeclared")).unionByName(said.exceptAll(true).withColumn("problem", F.lit("untrue")))


def impacts(current: DataFrame, changes: DataFrame, drifted: DataFrame) -> DataFrame:
    """version_id, decision and reasons for each current version of a changed unit.

    current: version_id, unit_id, index_id; changes: unit_id, kind, changed_fields; drifted: index_id of indexes
    that changed. A removal disables; a change of scopes or content asks for a review; provenance alone does
    nothing; index drift blocks, and then the change of scopes it implies is not reported again.
    """
    d = drifted.select("index_id", F.lit(True).alias("_drift")).distinct()
    j = current.join(changes, "unit_id").join(d, "index_id", "left").withColumn("_drift", F.coalesce("_drift", F.lit(False)))
    reasons = F.when(F.col("kind") == "removed", F.array(F.lit("unit.removed"))).otherwise(
        F.concat(F.when(F.col("_drift"), F.array(F.lit("index.drift"))).otherwise(F.array().cast("array<string>")), F.transform(F.filter("changed_fields", lambda f: (f != "provenance") & ~((f == "scopes") & F.col("_drift"))), lambda f: F.concat(F.lit("published."), f)))
    )
    decision = F.when(F.col("kind") == "removed", "disable").when(F.col("_drift"), "block").when(F.size(reasons) > 0, "review").otherwise("none")
    return j.select("version_id", decision.alias("decision"), F.array_sort(reasons).alias("reasons"))


def reachability(observed: DataFrame) -> DataFrame:
    """scope_id and state, from flags of each scope, in the order of STATES. observed: scope_id, registered, shapes, approved, validated, withdrawn."""
    state = (
        F.when(~F.col("registered"), "pending_registry")
        .when(F.col("shapes") > 1, "broken")
        .when(F.col("approved"), "reachable")
        .when(F.col("validated"), "pending_approval")
        .when(F.col("withdrawn"), "intentionally_unexposed")
        .otherwise("orphaned")
    )
    return observed.select("scope_id", state.alias("state"))


def reachability_counts(states: DataFrame) -> DataFrame:
    """Every state with its count, zero included."""
    all_states = states.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return all_states.join(states.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def coverage(states: DataFrame) -> DataFrame:
    """Reachable scopes by those that should be; 1 if there are none. broken and orphaned gates beside it."""
    n = lambda s: F.count_if(F.col("state") == s)
    due = F.count("*") - n("pending_registry") - n("intentionally_unexposed")
    return states.agg(F.coalesce(F.try_divide(n("reachable"), due), F.lit(1.0)).alias("coverage"), (n("broken") > 0).alias("broken_gate"), (n("orphaned") > 0).alias("orphaned_gate"))


def lags(published: DataFrame, processed: DataFrame) -> DataFrame:
    """source_id, behind, lag_ms; what is unknown stays null. published: source_id, publication_id, produced_at; processed the same with processed_at."""
    p = latest(published, "source_id", F.desc("produced_at"), F.desc("publication_id"))
    q = latest(processed, "source_id", F.desc("processed_at"), F.desc("publication_id")).select("source_id", F.col("publication_id").alias("_seen"), "processed_at")
    j = p.join(q, "source_id", "left")
    behind = ~F.col("publication_id").eqNullSafe(F.col("_seen"))
    return j.select("source_id", behind.alias("behind"), T.elapsed_ms(F.col("processed_at"), F.col("produced_at")).alias("lag_ms"))


def stale(pending: DataFrame, now: Column, threshold: int = STALE_MS) -> DataFrame:
    return pending.where(T.elapsed_ms(F.col("since"), now) > threshold)


def decisions(events: DataFrame) -> DataFrame:
    """Lifecycle events that decide about a scope, as promoted, refused or withdrawn."""
    kind = F.when(F.col("kind") == "promoted", "promoted").when(F.col("kind") == "rejected", "refused").when(F.col("kind").isin("disabled", "blocked"), "withdrawn")
    return events.withColumn("decision", kind).where(F.col("decision").isNotNull())


def folded(events: DataFrame) -> DataFrame:
    """The state of each card after its events: what an event-sourced promote, rollback, reject or disable leaves. events: card_id, kind, version_id, append_order."""
    last = latest(events.where(F.col("kind").isin("promoted", "rolled_back", "rejected", "disabled", "blocked")), "card_id", F.desc("append_order"))
    return last.select("card_id", F.when(F.col("kind").isin("promoted", "rolled_back"), F.col("version_id")).alias("current_version_id"), F.col("kind").alias("last_kind"))


def grounding(cards: DataFrame) -> DataFrame:
    """version_id and finding for every limit that a card's meaning breaks. cards: version_id, description, questions, aliases, keywords, scopes."""
    texts = F.concat(F.array("description"), "questions", "aliases", "keywords")
    checks = {
        "description_too_long": F.length("description") > 1024,
        "too_many_questions": F.size("questions") > 16,
        "question_too_long": F.exists("questions", lambda x: F.length(x) > 512),
        "too_many_aliases": F.size("aliases") > 32,
        "alias_too_long": F.exists("aliases", lambda x: F.length(x) > 128),
        "too_many_keywords": F.size("keywords") > 64,
        "keyword_not_allowed": F.exists("keywords", lambda x: ~T.allowed_keyword(x)),
        "too_many_scopes": F.size("scopes") > 64,
        "control_character": F.exists(texts, lambda x: x.rlike("[\\x00-\\x08\\x0b-\\x1f\\x7f]")),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return cards.select("version_id", F.explode(found).alias("finding"))


def retrieval_scopes(published: DataFrame) -> DataFrame:
    """scope_id, kind and target of published scopes as a reader asks for them; a document scope without units is the whole document."""
    target = (
        F.when(F.col("kind") == "managed_document", F.concat_ws("|", "document_id", F.array_join(F.array_sort("unit_ids"), ",")))
        .when(F.col("kind") == "sql_source", F.concat_ws("|", "connector", F.concat_ws(".", "schema_name", "table_name"), F.array_join(F.array_sort("columns"), ",")))
        .otherwise(F.concat_ws("|", "connector", F.concat_ws(" ", "method", "path")))
    )
    return published.select("scope_id", "kind", target.alias("target"))


def lane_status(observed: DataFrame) -> DataFrame:
    """lane and status, from ready, failures and waiting of each lane: not_ready, degraded, behind or ready."""
    status = F.when(~F.col("ready"), "not_ready").when(F.col("failures") > 0, "degraded").when(F.col("waiting") > 0, "behind").otherwise("ready")
    return observed.select("lane", status.alias("status"))


def serviceable(lanes: DataFrame) -> DataFrame:
    """True unless a lane is not ready; true without lanes."""
    return lanes.agg(F.coalesce(F.bool_and(F.col("status") != "not_ready"), F.lit(True)).alias("serviceable"))
