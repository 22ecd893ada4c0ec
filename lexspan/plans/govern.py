"""Registry, governance and maintenance over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as R, retention
from .text import read

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def versions(spark, d):
    """Line items as versions of the card of their part."""
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("card_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version_id"), F.col("l_shipdate").alias("created_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("append_order"), F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("scope"))


VERSIONS = "versions AS (SELECT l_partkey AS card_id, l_orderkey * 10 + l_linenumber AS version_id, l_shipdate AS created_at, l_returnflag AS flag, l_suppkey AS scope FROM lineitem)"


def publications(spark, d):
    return R.chained(read(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("publication_id"), F.col("o_orderdate").alias("produced_at"), F.col("o_orderstatus").alias("status")))


PUBLICATIONS = "publications AS (SELECT o_custkey AS source_id, o_orderkey AS publication_id, o_orderdate AS produced_at, o_orderstatus AS status, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_id FROM orders)"


@query(f"WITH {VERSIONS} SELECT card_id, version_id, flag FROM versions QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY version_id DESC) = 1")
def jn1_current_versions(spark, d):
    return R.current_versions(versions(spark, d)).select("card_id", "version_id", "flag")


@query(f"WITH {VERSIONS}, c AS (SELECT card_id, max(version_id) AS current_version_id FROM versions GROUP BY 1 HAVING card_id % 3 > 0) SELECT c.card_id, current_version_id, flag, scope FROM c JOIN versions v ON v.version_id = c.current_version_id AND v.card_id = c.card_id")
def jn2_approved_catalog(spark, d):
    v = versions(spark, d)
    cards = v.groupBy("card_id").agg(F.max("version_id").alias("m")).select("card_id", F.when(F.col("card_id") % 3 > 0, F.col("m")).alias("current_version_id"))
    return R.approved_catalog(cards, v).select("card_id", "current_version_id", "flag", "scope")


@query(f"""WITH {VERSIONS} SELECT scope AS scope_id, min(created_at) AS first_seen, max(created_at) AS last_seen, count(*) AS carriers, count(DISTINCT card_id) AS cards FROM versions GROUP BY 1""")
def jn3_a12_a14_scope_sightings(spark, d):
    return versions(spark, d).groupBy(F.col("scope").alias("scope_id")).agg(F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.count("*").alias("carriers"), F.count_distinct("card_id").alias("cards"))


@query(f"WITH {PUBLICATIONS} SELECT source_id, publication_id, status FROM publications QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY produced_at DESC, publication_id DESC) = 1")
def jn4_jn5_jn6_latest_by_pointer(spark, d):
    p = publications(spark, d)
    pointer = R.latest(p, "source_id", F.desc("produced_at"), F.desc("publication_id")).select("source_id", "publication_id")
    return p.join(pointer, ["source_id", "publication_id"]).select("source_id", "publication_id", "status")


@query(f"WITH {PUBLICATIONS} SELECT publication_id, source_id, previous_id FROM publications")
def w13_publication_chain(spark, d):
    return publications(spark, d).select("publication_id", "source_id", "previous_id")


@query(f"""WITH {PUBLICATIONS}, processed AS (SELECT * FROM publications WHERE status = 'F'), cursors AS (SELECT source_id, arg_max(publication_id, (produced_at, publication_id)) AS cursor FROM processed GROUP BY 1)
SELECT p.publication_id, CASE WHEN p.status = 'F' THEN 'already_claimed' WHEN p.previous_id IS NULL AND c.cursor IS NULL THEN 'first' WHEN p.previous_id = c.cursor THEN 'next' WHEN p.previous_id IS NULL OR b.publication_id IS NOT NULL THEN 'fork' ELSE 'deferred' END AS claim
FROM publications p LEFT JOIN cursors c USING (source_id) LEFT JOIN processed b ON b.publication_id = p.previous_id""")
def g1_claims(spark, d):
    p = publications(spark, d)
    done = p.where("status = 'F'")
    cursors = R.latest(done, "source_id", F.desc("produced_at"), F.desc("publication_id")).select("source_id", F.col("publication_id").alias("cursor"))
    return R.claims(p.select("source_id", "publication_id", "previous_id"), done.select("publication_id"), cursors)


def parts(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("unit_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    now = p.where("size <> 50").withColumn("unit_id", F.when(F.col("size") == 49, F.col("unit_id") + 1_000_000_000).otherwise(F.col("unit_id")))
    now = now.withColumn("price", F.when(F.col("size") < 10, F.col("price") + 1).otherwise(F.col("price"))).withColumn("brand", F.when(F.col("size") % 7 == 0, F.upper("type")).otherwise(F.col("brand")))
    return p, now


PARTS = """prev AS (SELECT p_partkey AS unit_id, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS price FROM part),
cur AS (SELECT CASE WHEN size = 49 THEN unit_id + 1000000000 ELSE unit_id END AS unit_id, CASE WHEN size % 7 = 0 THEN upper(type) ELSE brand END AS brand, type, size, CASE WHEN size < 10 THEN price + 1 ELSE price END AS price FROM prev WHERE size <> 50),
delta AS (SELECT coalesce(p.unit_id, c.unit_id) AS unit_id, CASE WHEN p.unit_id IS NULL THEN 'added' WHEN c.unit_id IS NULL THEN 'removed' ELSE 'updated' END AS kind,
  CASE WHEN p.unit_id IS NULL OR c.unit_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN p.brand IS DISTINCT FROM c.brand THEN 'brand' END, CASE WHEN p.price IS DISTINCT FROM c.price THEN 'price' END) END AS changed_fields
  FROM prev p FULL JOIN cur c ON p.unit_id = c.unit_id WHERE p.unit_id IS NULL OR c.unit_id IS NULL OR p.brand IS DISTINCT FROM c.brand OR p.price IS DISTINCT FROM c.price)"""
FIELDS = ["brand", "type", "size", "price"]


@query(f"WITH {PARTS} SELECT * FROM delta")
def jn7_m19_publication_delta(spark, d):
    return R.delta(*parts(spark, d), "unit_id", FIELDS).withColumn("changed_fields", F.array_join("changed_fields", ","))


@query(f"WITH {PARTS} SELECT kind, count(*) AS n FROM delta GROUP BY 1")
def u4_a11_change_counts(spark, d):
    return R.delta(*parts(spark, d), "unit_id", FIELDS).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {PARTS} SELECT unit_id, kind, changed_fields AS fields, 'undeclared' AS problem FROM delta WHERE unit_id % 10 = 0")
def m20_transition_violations(spark, d):
    p, c = parts(spark, d)
    return R.transition_violations(p, c, R.delta(p, c, "unit_id", FIELDS).where("unit_id % 10 <> 0"), "unit_id", FIELDS)


@query(f"""WITH {PARTS}, {VERSIONS}, current AS (SELECT card_id AS unit_id, max(version_id) AS version_id FROM versions GROUP BY 1)
SELECT version_id, CASE WHEN kind = 'removed' THEN 'disable' WHEN unit_id % 4 = 0 THEN 'block' WHEN changed_fields <> '' THEN 'review' ELSE 'none' END AS decision,
  CASE WHEN kind = 'removed' THEN 'unit.removed' ELSE concat_ws(',', CASE WHEN unit_id % 4 = 0 THEN 'index.drift' END, CASE WHEN contains(changed_fields, 'brand') THEN 'published.brand' END, CASE WHEN contains(changed_fields, 'price') THEN 'published.price' END) END AS reasons
FROM current JOIN delta USING (unit_id)""")
def g4_jn19_impacts(spark, d):
    cur = R.current_versions(versions(spark, d)).select("version_id", F.col("card_id").alias("unit_id"), (F.col("card_id") % 16).alias("index_id"))
    drifted = spark.range(0, 16, 4).select(F.col("id").alias("index_id"))
    return R.impacts(cur, R.delta(*parts(spark, d), "unit_id", FIELDS), drifted).withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH {PARTS} SELECT DISTINCT unit_id % 16 AS index_id FROM delta WHERE kind = 'removed'")
def jn20_indexes_with_removals(spark, d):
    gone = R.delta(*parts(spark, d), "unit_id", FIELDS).where("kind = 'removed'")
    return gone.select((F.col("unit_id") % 16).alias("index_id")).distinct()


OBSERVED = """observed AS (SELECT l_suppkey AS scope_id, s_suppkey % 11 > 0 AS registered, count(DISTINCT CASE WHEN l_suppkey % 13 = 0 THEN l_returnflag END) AS shapes, bool_or(l_quantity > 49.5 AND l_returnflag = 'R') AS approved, bool_or(l_returnflag = 'A' AND l_quantity > 49.5) AS validated, bool_or(l_returnflag = 'N' AND l_quantity > 49.5) AS withdrawn
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
states AS (SELECT scope_id, CASE WHEN NOT registered THEN 'pending_registry' WHEN shapes > 1 THEN 'broken' WHEN approved THEN 'reachable' WHEN validated THEN 'pending_approval' WHEN withdrawn THEN 'intentionally_unexposed' ELSE 'orphaned' END AS state FROM observed)"""


def states(spark, d):
    much = F.col("l_quantity") > 49.5
    flag = lambda x: F.bool_or(much & (F.col("l_returnflag") == x))
    o = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("scope_id")).agg(F.count_distinct(F.when(F.col("l_suppkey") % 13 == 0, F.col("l_returnflag"))).alias("shapes"), flag("R").alias("approved"), flag("A").alias("validated"), flag("N").alias("withdrawn"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("scope_id"), (F.col("s_suppkey") % 11 > 0).alias("registered"))
    return R.reachability(o.join(s, "scope_id"))


@query(f"WITH {OBSERVED} SELECT * FROM states")
def g8_reachability(spark, d):
    return states(spark, d)


@query(f"WITH {OBSERVED} SELECT s.state, count(scope_id) AS n FROM (SELECT unnest(['pending_registry', 'broken', 'reachable', 'pending_approval', 'intentionally_unexposed', 'orphaned']) AS state) s LEFT JOIN states USING (state) GROUP BY 1")
def a4_reachability_counts(spark, d):
    return R.reachability_counts(states(spark, d))


@query(f"WITH {OBSERVED} SELECT round(coalesce(count(*) FILTER (state = 'reachable') / nullif(CAST(count(*) FILTER (state NOT IN ('pending_registry', 'intentionally_unexposed')) AS DOUBLE), 0), 1.0), 9) AS coverage, count(*) FILTER (state = 'broken') > 0 AS broken_gate, count(*) FILTER (state = 'orphaned') > 0 AS orphaned_gate FROM states")
def a5_g10_coverage_and_gates(spark, d):
    return R.coverage(states(spark, d)).withColumn("coverage", F.round("coverage", 9))


@query("SELECT s_suppkey AS scope_id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49.5)")
def jn21_awaiting_registry(spark, d):
    seen = read(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49.5").select(F.col("l_suppkey").alias("scope_id"))
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("scope_id")).join(seen, "scope_id", "left_anti")


@query(f"""WITH {PUBLICATIONS}, p AS (SELECT source_id, publication_id, produced_at FROM publications QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY produced_at DESC, publication_id DESC) = 1),
q AS (SELECT source_id, publication_id AS seen, produced_at AS processed_at FROM publications WHERE status = 'F' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY produced_at DESC, publication_id DESC) = 1)
SELECT source_id, publication_id IS DISTINCT FROM seen AS behind, epoch_us(produced_at) // 1000 - epoch_us(processed_at) // 1000 AS lag_ms FROM p LEFT JOIN q USING (source_id)""")
def g11_r5_processing_lag(spark, d):
    p = publications(spark, d)
    return R.lags(p.select("source_id", "publication_id", "produced_at"), p.where("status = 'F'").select("source_id", "publication_id", F.col("produced_at").alias("processed_at")))


@query("SELECT o_orderkey AS scope_id FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 5 MINUTE")
def p12_x6_stale_pending(spark, d):
    o = read(spark, d, "orders")
    now = o.agg(F.max("o_orderdate").alias("now"))
    pending = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("scope_id"), F.col("o_orderdate").alias("since")).join(F.broadcast(now))  # one row
    return R.stale(pending, F.col("now")).select("scope_id")


def lifecycle(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "promoted").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "signup", "disabled").otherwise("observed")
    return read(spark, d, "events").select(F.col("user_id").alias("card_id"), kind.alias("kind"), F.col("event_id").alias("version_id"), F.col("ts").alias("occurred_at"), F.col("event_id").alias("append_order"))


LIFECYCLE = "lifecycle AS (SELECT user_id AS card_id, CASE event_type WHEN 'purchase' THEN 'promoted' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'disabled' ELSE 'observed' END AS kind, event_id AS version_id, ts AS occurred_at FROM events)"


@query(f"WITH {LIFECYCLE} SELECT version_id, card_id, CASE kind WHEN 'promoted' THEN 'promoted' WHEN 'rejected' THEN 'refused' ELSE 'withdrawn' END AS decision FROM lifecycle WHERE kind <> 'observed'")
def r4_scope_decisions(spark, d):
    return R.decisions(lifecycle(spark, d)).select("version_id", "card_id", "decision")


@query(f"WITH {LIFECYCLE} SELECT card_id, CASE WHEN kind = 'promoted' THEN version_id END AS current_version_id, kind AS last_kind FROM lifecycle WHERE kind <> 'observed' QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY version_id DESC) = 1")
def g5_g6_s8_folded_events(spark, d):
    return R.folded(lifecycle(spark, d))


@query(f"WITH {LIFECYCLE} SELECT card_id, kind, arg_min(version_id, (-epoch_us(occurred_at), version_id)) AS version_id FROM lifecycle GROUP BY 1, 2")
def a13_latest_decision(spark, d):
    return R.latest(lifecycle(spark, d), ["card_id", "kind"], F.desc("occurred_at"), F.asc("append_order")).select("card_id", "kind", "version_id")


@query(f"WITH {LIFECYCLE}, m AS (SELECT max(occurred_at) AS now FROM lifecycle) SELECT kind, max(epoch_us(now) // 1000 - epoch_us(occurred_at) // 1000) AS oldest_ms FROM lifecycle, m GROUP BY 1")
def a6_oldest_state_age(spark, d):
    from ..functions import text as T

    e = lifecycle(spark, d)
    now = e.agg(F.max("occurred_at").alias("now"))
    return e.join(F.broadcast(now)).groupBy("kind").agg(F.max(T.elapsed_ms(F.col("occurred_at"), F.col("now"))).alias("oldest_ms"))


@query("""WITH o AS (SELECT event_id AS observation_id, user_id AS source_id, ts AS captured_at, event_type FROM events), n AS (SELECT max(captured_at) AS now FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY captured_at DESC, observation_id DESC) AS rn FROM o)
SELECT observation_id, source_id FROM r, n WHERE rn > 2 AND captured_at < now - INTERVAL 7 DAY AND event_type NOT IN ('purchase', 'signup')""")
def p8_w1_g12_removable_observations(spark, d):
    o = read(spark, d, "events").select(F.col("event_id").alias("observation_id"), F.col("user_id").alias("source_id"), F.col("ts").alias("captured_at"), "event_type")
    now = o.agg(F.max("captured_at").alias("now"))
    kept = [o.where(F.col("event_type") == k).select("observation_id") for k in ("purchase", "signup")]
    return retention.removable(o.join(F.broadcast(now)), F.col("now"), *kept).select("observation_id", "source_id")


OUTBOX = "outbox AS (SELECT event_id AS publication_id, CASE WHEN event_type = 'click' THEN 'pending' WHEN event_type = 'view' THEN 'delivering' ELSE 'delivered' END AS state, ts AS next_attempt_at, ts + INTERVAL 30 SECOND AS lease_expires_at FROM events), n AS (SELECT TIMESTAMP '2024-01-15 00:00:00' AS now)"


def outbox(spark, d):
    state = F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "delivering").otherwise("delivered")
    return read(spark, d, "events").select(F.col("event_id").alias("publication_id"), state.alias("state"), F.col("ts").cast("timestamp").alias("next_attempt_at"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 30 SECONDS")).alias("lease_expires_at"))


def _now():
    return F.expr("TIMESTAMP '2024-01-15 00:00:00'")


@query(f"WITH {OUTBOX} SELECT publication_id, state FROM outbox, n WHERE (state = 'pending' AND next_attempt_at <= now) OR (state = 'delivering' AND lease_expires_at <= now)")
def p9_outbox_due(spark, d):
    return retention.due(outbox(spark, d), _now()).select("publication_id", "state")


@query(f"WITH {OUTBOX} SELECT publication_id FROM outbox, n WHERE (state = 'pending' AND next_attempt_at <= now) OR (state = 'delivering' AND lease_expires_at <= now) ORDER BY next_attempt_at, publication_id LIMIT 25")
def t8_x1_claimed_batch(spark, d):
    return retention.claim_batch(outbox(spark, d), _now()).select("publication_id")


@query(f"""WITH a AS (SELECT o_orderkey AS index_version, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'publishing' END AS state, CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 5 MINUTE END AS lease_expires_at FROM orders), n AS (SELECT max(created_at) - INTERVAL 400 DAY AS now FROM a),
o AS (SELECT index_version, CASE WHEN NOT (created_at < now - INTERVAL 24 HOUR AND (state = 'pending' OR lease_expires_at IS NULL OR lease_expires_at <= now)) THEN 'active' WHEN index_version IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'referenced' ELSE 'deleted' END AS outcome FROM a, n)
SELECT outcome, count(*) AS n FROM o GROUP BY 1""")
def p10_g13_a17_staging_cleanup(spark, d):
    o = read(spark, d, "orders")
    a = o.select(F.col("o_orderkey").alias("index_version"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("publishing").alias("state"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate") + F.expr("INTERVAL 5 MINUTES")).alias("lease_expires_at"))
    now = a.agg((F.max("created_at") - F.expr("INTERVAL 400 DAYS")).alias("now"))
    refs = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("index_version"))
    return retention.outcome_counts(retention.staging_outcomes(a.join(F.broadcast(now)), refs, F.col("now")))


@query("""WITH k AS (SELECT doc_id AS version_id, text AS description, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+')) AS keywords FROM documents)
SELECT version_id, finding FROM (SELECT version_id, unnest([CASE WHEN length(description) > 1024 THEN 'description_too_long' END, CASE WHEN len(keywords) > 64 THEN 'too_many_keywords' END,
  CASE WHEN len(list_filter(keywords, lambda x: NOT (length(x) <= 64 AND (length(x) >= 2 OR regexp_full_match(x, '\\p{N}'))))) > 0 THEN 'keyword_not_allowed' END,
  CASE WHEN regexp_matches(description, '[\\x00-\\x08\\x0b-\\x1f\\x7f]') OR len(list_filter(keywords, lambda x: regexp_matches(x, '[\\x00-\\x08\\x0b-\\x1f\\x7f]'))) > 0 THEN 'control_character' END]) AS finding FROM k) WHERE finding IS NOT NULL""")
def g3_p11_grounding(spark, d):
    from ..functions import text as T

    none = F.array().cast("array<string>")
    c = read(spark, d, "documents").select(F.col("doc_id").alias("version_id"), F.col("text").alias("description"), none.alias("questions"), none.alias("aliases"), F.array_distinct(T.word_terms(F.col("text"))).alias("keywords"), none.alias("scopes"))
    return R.grounding(c)
