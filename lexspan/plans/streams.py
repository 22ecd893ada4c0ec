"""The change feed and stores, and relational extras, as queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as T
from ..sources import store
from ..storage import shared_dir
from ..streaming import feed
from .govern import publications
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


@query("SELECT o_custkey AS source_id, o_orderkey AS publication_id, CASE WHEN row_number() OVER w = 1 THEN 'first' ELSE 'next' END AS outcome, row_number() OVER w AS position FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def x1_x2_x3_change_feed(spark, d):
    """Orders as publications, streamed from files in arrival order and taken in chain order."""
    import uuid

    at = f"{shared_dir(spark)}/lexspan-feed-{uuid.uuid4().hex}"
    publications(spark, d).select(F.col("source_id").cast("long").alias("source_id"), F.col("publication_id").cast("long").alias("publication_id"), F.col("previous_id").cast("long").alias("previous_id")).write.parquet(f"{at}/in")
    stream = feed.in_chain_order(spark.readStream.schema(feed.FEED).parquet(f"{at}/in"))
    feed.run_available(stream, f"{at}/checkpoint", lambda df, k: df.write.mode("overwrite").parquet(f"{at}/out/batch={k}"))
    return spark.read.parquet(f"{at}/out").where("outcome IN ('first', 'next')").select("source_id", "publication_id", "outcome", "position")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x_windowed_counts(spark, d):
    c = feed.windowed_counts(read(spark, d, "events"))
    return c.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
n AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS n FROM n GROUP BY 1, 2""")
def x_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = read(spark, d, "events").withColumn("s", F.when(F.col("ts") - F.lag("ts").over(w) < F.expr("INTERVAL 6 HOURS"), 0).otherwise(1))
    return g.withColumn("session", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def x_rollup(spark, d):
    return read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT n_name, r_name, CAST(rank() OVER (PARTITION BY r_name ORDER BY total DESC) AS INTEGER) AS rank, total FROM (SELECT n_name, r_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)")
def x_joined_ranks(spark, d):
    o, c = read(spark, d, "orders").select("o_custkey", "o_totalprice"), read(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed tables
    per = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    t = per.groupBy("n_name", "r_name").agg(F.round(F.sum("t"), 2).alias("total"))
    return t.select("n_name", "r_name", F.rank().over(Window.partitionBy("r_name").orderBy(F.desc("total"))).alias("rank"), "total")


@query("""WITH h AS (SELECT item_id, sha256('deterministic-v1' || chr(0) || text || chr(0) || '0') || sha256('deterministic-v1' || chr(0) || text || chr(0) || '1') AS hex FROM benchmark),
v AS (SELECT item_id, list_transform(range(0, 64), lambda i: (16 * (position(hex[2 * i + 1] IN '0123456789abcdef') - 1) + position(hex[2 * i + 2] IN '0123456789abcdef') - 1) / 127.5 - 1) AS v FROM h)
SELECT item_id AS chunk_revision_id, CAST(len(v) AS INTEGER) AS dimensions, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM v""")
def s20_m24_deterministic_embeddings(spark, d):
    chunks = read(spark, d, "benchmark").select(F.col("item_id").alias("chunk_revision_id"), "text", T.digest(F.col("text")).alias("digest"))
    cache = store.embedded(chunks.where("chunk_revision_id % 2 = 0")).select("chunk_revision_id", "digest", "embedding")
    e = store.embed_new(chunks, cache)
    return e.select("chunk_revision_id", F.size("embedding").alias("dimensions"), F.round(F.element_at("embedding", 1), 6).alias("first"))


@query("SELECT vec_id AS record_id, label, 'label-' || coalesce(CAST(label AS VARCHAR), 'None') AS document_index_id, CASE WHEN label % 2 = 1 THEN 'v2' ELSE 'v1' END AS index_version FROM embeddings")
def s9_s15_m22_index_store(spark, d):
    """Publishes each label's vectors as an index of its own, for odd labels as a second version, and reads all current versions."""
    import uuid

    s = store.Store(spark, f"{shared_dir(spark)}/lexspan-store-{uuid.uuid4().hex}", "cosine-64")
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("record_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    labels = sorted({r["label"] for r in e.select("label").distinct().collect()}, key=lambda x: (x is not None, x or 0))
    for before, x in zip([labels[-1], *labels], labels, strict=False):
        own = lambda k: e.where(F.col("label").eqNullSafe(F.lit(k)))
        odd = x is not None and x % 2 == 1
        if odd:
            s.publish(f"label-{x}", "v1", own(before))
        s.publish(f"label-{x}", "v2" if odd else "v1", own(x))
    cur = F.broadcast(s.current())  # one row for each index
    return s.records().join(cur, ["document_index_id", "index_version"]).select("record_id", "label", "document_index_id", "index_version")


@query("""WITH v AS (SELECT o_orderkey AS index_version, o_orderdate FROM orders), l AS (SELECT l_orderkey AS index_version FROM lineitem WHERE l_shipdate + INTERVAL 30 DAY > TIMESTAMP '1998-06-01')
SELECT index_version FROM v WHERE index_version NOT IN (SELECT index_version FROM l)""")
def s15_deletable_versions(spark, d):
    leases = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("index_version"), (F.col("l_shipdate").cast("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))
    return store.deletable(read(spark, d, "orders").select(F.col("o_orderkey").alias("index_version")), leases, F.lit("1998-06-01").cast("timestamp"))
