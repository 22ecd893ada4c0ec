"""Identity of chunks and units, scopes and lanes over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage as L, registry as R
from .documents import LINES, docs, lines
from .text import read

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


CHUNKS = f"""{LINES}, p AS (SELECT doc_id, ord, ord // 8 AS unit, ord // 2 AS fb, length(text) AS n, CASE WHEN ord % 3 = 0 THEN length(text) ELSE 1 END AS z, sha256(text) AS digest FROM lines),
c AS (SELECT doc_id, ord + 1 AS ord, unit, CASE WHEN ord % 4 = 1 THEN fb + 50 ELSE fb END AS fb, n, z, digest FROM p WHERE ord % 7 <> 5),
pk AS (SELECT doc_id, unit, fb, CASE WHEN z = n THEN -1 ELSE z END AS e, min(ord) AS previous FROM p GROUP BY 1, 2, 3, 4 HAVING count(*) = 1), ck AS (SELECT doc_id, unit, fb, CASE WHEN z = n THEN -1 ELSE z END AS e, min(ord) AS current FROM c GROUP BY 1, 2, 3, 4 HAVING count(*) = 1),
one AS (SELECT doc_id, previous, current, 'boundary' AS how FROM pk JOIN ck USING (doc_id, unit, fb, e)),
pr AS (SELECT doc_id, unit, digest, min(ord) AS previous FROM p WHERE (doc_id, ord) NOT IN (SELECT (doc_id, previous) FROM one) GROUP BY 1, 2, 3 HAVING count(*) = 1), cr AS (SELECT doc_id, unit, digest, min(ord) AS current FROM c WHERE (doc_id, ord) NOT IN (SELECT (doc_id, current) FROM one) GROUP BY 1, 2, 3 HAVING count(*) = 1)"""


@query(f"WITH {CHUNKS} SELECT * FROM one UNION ALL SELECT doc_id, previous, current, 'content' FROM pr JOIN cr USING (doc_id, unit, digest)")
def m11_carried_chunks(spark, d):
    x = lines(docs(spark, d))
    n = F.length("text")
    p = x.select("doc_id", "ord", F.floor(F.col("ord") / 8).alias("unit"), F.floor(F.col("ord") / 2).alias("first_block"), F.lit(0).alias("first_at"), F.lit(0).alias("last_block"), F.when(F.col("ord") % 3 == 0, n).otherwise(1).alias("last_at"), n.alias("last_length"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.lit("blocks").alias("split"))
    c = p.where("ord % 7 <> 5").withColumn("first_block", F.when(F.col("ord") % 4 == 1, F.col("first_block") + 50).otherwise(F.col("first_block"))).withColumn("ord", F.col("ord") + 1)
    return L.carried_chunks(p, c)


UNITS = f"""{LINES}, u AS (SELECT doc_id, ord // 4 AS unit, ord FROM lines), v AS (SELECT doc_id, ord // 6 AS unit, ord FROM lines WHERE ord % 11 <> 3),
o AS (SELECT DISTINCT doc_id, u.unit AS p, v.unit AS c FROM u JOIN v USING (doc_id, ord)), b AS (SELECT doc_id, c, count(*) AS sources FROM o GROUP BY 1, 2), a AS (SELECT doc_id, p, count(*) AS heirs FROM o GROUP BY 1, 2),
x AS (SELECT doc_id, c, max(sources) AS sources, max(heirs) AS heirs FROM o JOIN b USING (doc_id, c) JOIN a USING (doc_id, p) GROUP BY 1, 2), y AS (SELECT doc_id, p, max(sources) AS sources, max(heirs) AS heirs FROM o JOIN b USING (doc_id, c) JOIN a USING (doc_id, p) GROUP BY 1, 2)"""
_WHY = "CASE WHEN heirs > 1 AND sources > 1 THEN 'ambiguous' WHEN sources > 1 THEN 'merge' WHEN heirs > 1 THEN 'split' ELSE 'ambiguous' END"


@query(f"""WITH {UNITS} SELECT doc_id, 'current' AS side, CAST(c AS INTEGER) AS ord, CASE WHEN c = 0 THEN 'inherited' ELSE {_WHY} END AS decision FROM x
UNION ALL SELECT q.doc_id, 'previous', CAST(q.unit AS INTEGER), CASE WHEN y.sources IS NULL THEN 'deleted' ELSE {_WHY} END FROM (SELECT DISTINCT doc_id, unit FROM u) q LEFT JOIN y ON y.doc_id = q.doc_id AND y.p = q.unit WHERE NOT (q.unit = 0 AND EXISTS (SELECT 1 FROM x WHERE x.doc_id = q.doc_id AND x.c = 0))""")
def m9_unit_decisions(spark, d):
    x = lines(docs(spark, d)).select("doc_id", "ord")
    unit = lambda rows, k: rows.groupBy("doc_id", F.floor(F.col("ord") / k).cast("int").alias("u")).agg(F.collect_list("ord").alias("blocks")).select("doc_id", F.col("u").alias("ord"), "blocks")
    p, c = unit(x, 4), unit(x.where("ord % 11 <> 3"), 6)
    first = c.where("ord = 0").select("doc_id", F.lit(0).alias("previous"), F.lit(0).alias("current"))
    return L.unit_decisions(p, c, first)


@query("""SELECT s_suppkey AS scope_id, CASE s_suppkey % 3 WHEN 0 THEN 'managed_document' WHEN 1 THEN 'sql_source' ELSE 'http_source' END AS kind,
  CASE s_suppkey % 3 WHEN 0 THEN s_name || '|a,b' WHEN 1 THEN 'c|public.' || s_name || '|x,y' ELSE 'c|GET /' || s_nationkey END AS target FROM supplier""")
def r1_retrieval_scopes(spark, d):
    kind = F.when(F.col("s_suppkey") % 3 == 0, "managed_document").when(F.col("s_suppkey") % 3 == 1, "sql_source").otherwise("http_source")
    two = lambda a, b: F.array(F.lit(a), F.lit(b))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("scope_id"), kind.alias("kind"), F.col("s_name").alias("document_id"), two("b", "a").alias("unit_ids"), F.lit("c").alias("connector"), F.lit("public").alias("schema_name"), F.col("s_name").alias("table_name"), two("y", "x").alias("columns"), F.lit("GET").alias("method"), F.concat(F.lit("/"), F.col("s_nationkey").cast("string")).alias("path"))
    return R.retrieval_scopes(s)


@query("""WITH o AS (SELECT user_id AS lane, bool_or(event_type = 'signup') AS ready, count(*) FILTER (event_type = 'error' AND value > 150) AS failures, count(*) FILTER (event_type = 'click') AS waiting FROM events GROUP BY 1)
SELECT lane, CASE WHEN NOT ready THEN 'not_ready' WHEN failures > 0 THEN 'degraded' WHEN waiting > 0 THEN 'behind' ELSE 'ready' END AS status FROM o""")
def g14_lane_status(spark, d):
    e = read(spark, d, "events")
    o = e.groupBy(F.col("user_id").alias("lane")).agg(F.bool_or(F.col("event_type") == "signup").alias("ready"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 150)).alias("failures"), F.count_if(F.col("event_type") == "click").alias("waiting"))
    return R.lane_status(o)


@query("SELECT bool_and(ready) AS serviceable FROM (SELECT bool_or(event_type = 'signup') AS ready FROM events GROUP BY user_id)")
def a23_serviceable(spark, d):
    return R.serviceable(g14_lane_status(spark, d))
