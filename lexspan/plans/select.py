"""Search, selection and assembly over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly, search, selection
from ..storage import written
from .text import GRAMS, JACCARD, read

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


E = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"
COS = "round(CASE WHEN isnan(list_cosine_similarity(q.e, c.e)) THEN 0.0 ELSE list_cosine_similarity(q.e, c.e) END, 9)"


def vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("scope"))


def asked(spark, d):
    """Every row whose id is divisible by 20."""
    return vectors(spark, d).where("id % 20 = 0").withColumnRenamed("id", "query_id")


def _knn(distance: str, same_scope: bool, k: int):
    def run(spark, d):
        return search.top_k(vectors(spark, d), asked(spark, d), k, distance, same_scope).select("query_id", "id", F.round("score", 6).alias("score"), "rank")

    return run


def _knn_sql(score: str, scope: bool, k: int) -> str:
    return f"""WITH v AS ({E}), s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round({score}, 12) AS s FROM v q JOIN v c ON q.vec_id % 20 = 0{' AND q.label = c.label' if scope else ''})
SELECT query_id, id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= {k}"""


for _name, _distance, _scope, _k, _score in (
    ("t1_p1_scoped_cosine_top_k", "cosine", True, 10, "list_cosine_similarity(q.e, c.e)"),
    ("t1_dot_top_k", "dot", False, 10, "list_dot_product(q.e, c.e)"),
    ("t2_euclid_top_k", "euclid", False, 5, "1 / (1 + list_distance(q.e, c.e))"),
    ("t3_semantic_top_k", "cosine", False, 32, "list_cosine_similarity(q.e, c.e)"),
):
    Q[_name], SQL[_name] = _knn(_distance, _scope, _k), _knn_sql(_score, _scope, _k)


def cards(spark, d):
    """A catalog from the benchmark items: the longest words as keywords, the first sentence as question."""
    b = read(spark, d, "benchmark")
    words = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 7)))
    return b.select(
        F.col("item_id").alias("version_id"), F.slice(words, 1, 6).alias("keywords"), F.array(F.regexp_extract("text", "^[^.]*", 0)).alias("questions"), F.col("text").alias("description"),
        (F.col("item_id") % 7 == 0).alias("sensitive"), F.array(F.when(F.col("item_id") % 5 == 0, "audit").otherwise("retrieval")).alias("allowed_usage"),
    )


CARDS = """cards AS (SELECT item_id AS version_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 7)))[1:6] AS keywords,
  regexp_extract(text, '^[^.]*') AS question, text AS description, item_id % 7 = 0 AS sensitive, CASE WHEN item_id % 5 = 0 THEN 'audit' ELSE 'retrieval' END AS usage FROM benchmark)"""


def turns(spark, d):
    return read(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")


def _norm(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '\s+', ' ', 'g'))"


LEXICAL = f"""{CARDS},
c AS (SELECT version_id, keywords, {GRAMS.format(_norm('question'))} AS qg, {GRAMS.format(_norm('description'))} AS dg FROM cards),
q AS (SELECT conv_id * 1000 + turn AS query_id, {_norm('text')} AS q FROM conversations WHERE role = 'user'),
qq AS (SELECT *, {GRAMS.format('q')} AS g FROM q),
s AS (SELECT query_id, version_id, CASE WHEN len(list_filter(keywords, lambda k: contains(q, k))) > 0 THEN 0.9 + 0.1 * len(list_filter(keywords, lambda k: contains(q, k))) / len(keywords) ELSE 0.0 END AS direct,
  {JACCARD.format('g', 'qg')} AS question, 0.5 * ({JACCARD.format('g', 'dg')}) AS described FROM qq, c),
lexical AS (SELECT query_id, version_id, least(greatest(direct, question, described), 1.0) AS score,
  CASE WHEN direct > 0 THEN 'declared_term' WHEN question > 0 AND question >= described THEN 'question' WHEN described > 0 THEN 'description' ELSE 'none' END AS signal FROM s)"""


@query(f"WITH {LEXICAL} SELECT query_id, version_id, round(score, 9) AS score, signal FROM lexical")
def q1_q2_lexical_scores(spark, d):
    return selection.lexical_scores(turns(spark, d), cards(spark, d)).withColumn("score", F.round("score", 9))


VERDICT = "CASE WHEN isnan(score) THEN 'reject' WHEN score >= 0.85 THEN 'admit' WHEN score <= 0.35 THEN 'reject' ELSE 'defer' END"


@query(f"WITH {LEXICAL}, r AS (SELECT query_id, version_id, round(score, 9) AS score FROM lexical) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, version_id) AS INTEGER) AS position, {VERDICT} AS verdict FROM r")
def q5_t5_p5_judged(spark, d):
    return selection.judged(q1_q2_lexical_scores(spark, d).drop("signal"))


@query(f"WITH {LEXICAL}, r AS (SELECT query_id, {VERDICT} AS v FROM lexical) SELECT query_id, count(*) FILTER (v = 'admit') AS admit, count(*) FILTER (v = 'defer') AS defer, count(*) FILTER (v = 'reject') AS reject FROM r GROUP BY 1")
def a3_selection_summary(spark, d):
    return selection.summary(q5_t5_p5_judged(spark, d))


@query(f"WITH {CARDS} SELECT version_id FROM cards WHERE usage = 'retrieval' AND NOT sensitive")
def p2_p3_policy_eligible(spark, d):
    return selection.eligible(cards(spark, d)).select("version_id")


@query(f"""WITH {LEXICAL}, v AS ({E}), r AS (SELECT l.query_id, l.version_id, round(l.score, 9) AS score, round(list_cosine_similarity(q.e, c.e), 12) AS cosine
  FROM lexical l LEFT JOIN v q ON q.vec_id = l.query_id // 1000 LEFT JOIN v c ON c.vec_id = l.version_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, version_id) AS a, CASE WHEN cosine IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC NULLS LAST, version_id) END AS b FROM r),
f AS (SELECT *, CASE WHEN a <= 32 OR b <= 32 THEN cosine END AS c, CASE WHEN (a <= 32 OR b <= 32) AND cosine >= 0.75 THEN least((cosine - 0.75) / 0.25, 1.0) ELSE 0.0 END AS sem FROM top)
SELECT query_id, version_id, score AS lexical, round(c, 9) AS cosine, round(least(greatest(score, sem) + 0.1 * least(score, sem), 1.0), 6) AS score FROM f""")
def q3_jn15_u1_hybrid(spark, d):
    """Lexical scores of all turns with the cosines of the conversation's and the card's vectors, where both have one, for the union of both top lists."""
    from ..functions import vectors as V

    lexical = written(q1_q2_lexical_scores(spark, d).drop("signal"), "lexical")  # all pairs are scored once
    v = vectors(spark, d).select("id", F.col("embedding").cast("array<double>").alias("e"))
    asked_by = turns(spark, d).select("query_id").distinct().withColumn("id", F.floor(F.col("query_id") / 1000).cast("long"))
    own = asked_by.join(v, "id").select("query_id", F.col("e").alias("qe"))
    few = selection.bounded_catalog(v.join(cards(spark, d).select(F.col("version_id").alias("id")), "id"))
    nearest = search.top_k(few.select("id", F.lit(0).alias("scope"), F.col("e").alias("embedding")), own.select("query_id", F.lit(0).alias("scope"), F.col("qe").alias("embedding")), selection.TOP)
    nearest = nearest.select("query_id", F.col("id").alias("version_id"), F.col("score").alias("cosine"))
    listed = selection.best(lexical, "score").join(nearest, ["query_id", "version_id"], "left_anti")
    listed = listed.join(own, "query_id").join(few.select(F.col("id").alias("version_id"), "e"), "version_id").select("query_id", "version_id", F.round(V.cosine(F.col("qe"), F.col("e")), 12).alias("cosine"))
    h = selection.hybrid(lexical, nearest.unionByName(listed))
    return h.select("query_id", "version_id", F.round("lexical", 9).alias("lexical"), F.round("cosine", 9).alias("cosine"), F.round("score", 6).alias("score"))


@query(f"""WITH {LEXICAL}, a AS (SELECT query_id, version_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, version_id) AS position, round(score, 9) AS score FROM lexical)
SELECT query_id, version_id % 10 AS scope_key, 'guide ' || (version_id % 10) AS definition, array_to_string(list(version_id ORDER BY position), ',') AS selected_by FROM a WHERE score >= 0.85 GROUP BY ALL""")
def q6_u2_u3_plan(spark, d):
    a = q5_t5_p5_judged(spark, d).where("verdict = 'admit'")
    scope = F.col("version_id") % 10
    p = selection.planned(a.select("query_id", "version_id", "position", scope.alias("scope_key"), F.concat(F.lit("guide "), scope.cast("string")).alias("definition")))
    return p.withColumn("selected_by", F.array_join(F.transform("selected_by", lambda x: x.cast("string")), ","))


CANDIDATES = f"""v AS ({E}), s AS (SELECT q.vec_id AS query_id, c.vec_id AS revision, q.label = c.label AS same, round(list_cosine_similarity(q.e, c.e), 12) AS s FROM v q JOIN v c ON q.vec_id % 20 = 0),
one AS (SELECT query_id, revision, 1 AS target, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, revision) AS rank FROM s WHERE same QUALIFY rank <= 8),
two AS (SELECT query_id, revision, 2 AS target, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, revision) AS rank FROM s QUALIFY rank <= 8),
candidates AS (SELECT o.*, coalesce(sha256(d.text), 'no document ' || o.revision) AS digest, coalesce(length(d.text), 0) AS units FROM (SELECT * FROM one UNION ALL SELECT * FROM two) o LEFT JOIN documents d ON d.doc_id = o.revision)"""
FUSED = """fused AS (SELECT query_id, revision, round(sum(1.0 / (60 + rank)), 12) AS score, count(*) AS occurrences, min(rank) AS rank, arg_min(target, rank * 10 + target) AS target, any_value(digest) AS digest, any_value(units) AS units FROM candidates GROUP BY 1, 2)"""


def candidates(spark, d):
    """Hits with the digest and length of their documents; one without a document has a digest of its own and no length."""
    one = search.top_k(vectors(spark, d), asked(spark, d), 8, "cosine", True).withColumn("target", F.lit(1))
    two = search.top_k(vectors(spark, d), asked(spark, d), 8, "cosine", False).withColumn("target", F.lit(2))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("_d"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.length("text").alias("units"))
    c = one.unionByName(two)
    own = F.coalesce("digest", F.concat(F.lit("no document "), F.col("id").cast("string"))).alias("digest")
    return c.join(docs, F.col("id") == F.col("_d"), "left").select("query_id", "target", F.col("target").alias("item"), "rank", F.col("id").alias("revision"), own, F.coalesce("units", F.lit(0)).alias("units"))


@query(f"WITH {CANDIDATES}, {FUSED} SELECT query_id, revision, round(score, 9) AS score, CAST(occurrences AS INTEGER) AS occurrences, CAST(rank AS INTEGER) AS rank, target FROM fused")
def a1_q12_reciprocal_rank_fusion(spark, d):
    return assembly.fused(candidates(spark, d)).select("query_id", "revision", F.round("score", 9).alias("score"), "occurrences", "rank", "target")


@query(f"""WITH {CANDIDATES}, {FUSED}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, digest ORDER BY score DESC, rank, target, revision) = 1 AS live FROM fused),
r AS (SELECT *, sum(CASE WHEN live THEN units ELSE 0 END) OVER w AS run, sum(CAST(live AS INT)) OVER w AS place FROM o WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, rank, target, revision ROWS UNBOUNDED PRECEDING))
SELECT query_id, revision, round(score, 9) AS score, CASE WHEN NOT live THEN 'duplicate_content' WHEN run <= 8000 AND place <= 12 THEN 'kept' ELSE 'budget_exhausted' END AS outcome,
  CASE WHEN live AND run <= 8000 AND place <= 12 THEN CAST(place AS INTEGER) END AS context_rank FROM r""")
def hybrid_context(spark, d):
    """The flagship: scoped search, fusion, removal of repeats, budget (T1, P1, Q12, Q13, Q14, W3, W4, W5)."""
    f = assembly.fused(candidates(spark, d)).withColumn("score", F.round("score", 12))
    return assembly.kept(f).select("query_id", "revision", F.round("score", 9).alias("score"), "outcome", "context_rank")


@query(f"""WITH {CANDIDATES}, c AS (SELECT query_id, target, revision, digest, units + CASE WHEN target = 2 AND revision % 9 = 0 THEN 1 ELSE 0 END AS units FROM candidates),
bad AS (SELECT query_id, revision FROM c GROUP BY ALL HAVING count(DISTINCT (digest, units)) > 1), bad2 AS (SELECT query_id, digest FROM c GROUP BY ALL HAVING count(DISTINCT units) > 1)
SELECT DISTINCT query_id, target FROM c WHERE (query_id, revision) IN (SELECT (query_id, revision) FROM bad) OR (query_id, digest) IN (SELECT (query_id, digest) FROM bad2)""")
def q11_a2_quarantine(spark, d):
    c = candidates(spark, d).withColumn("units", F.col("units") + F.when((F.col("target") == 2) & (F.col("revision") % 9 == 0), 1).otherwise(0))
    return assembly.quarantined(c)


@query(f"WITH {CANDIDATES} SELECT query_id, target FROM candidates GROUP BY ALL HAVING count(*) <= 8 AND max(rank) = count(*) AND count(DISTINCT rank) = count(*) AND count(DISTINCT revision) = count(*)")
def q10_w14_sound_outcomes(spark, d):
    return assembly.sound(candidates(spark, d))


@query(f"""WITH {CANDIDATES}, {FUSED}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, digest ORDER BY score DESC, rank, target, revision) = 1 AS live FROM fused),
r AS (SELECT *, sum(CASE WHEN live THEN units ELSE 0 END) OVER w AS run, sum(CAST(live AS INT)) OVER w AS place FROM o WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, rank, target, revision ROWS UNBOUNDED PRECEDING)),
p AS (SELECT vec_id AS query_id, unnest([1, 2, 3]) AS item FROM embeddings WHERE vec_id % 20 = 0)
SELECT p.query_id, p.item, CASE p.item WHEN 3 THEN 'delegated' ELSE 'fulfilled' END AS status, count(*) FILTER (live AND run <= 8000 AND place <= 12) AS n_chunks, coalesce(bool_or(live AND NOT (run <= 8000 AND place <= 12)), false) AS truncated
FROM p LEFT JOIN r ON p.query_id = r.query_id AND p.item = r.target GROUP BY 1, 2""")
def q16_jn14_response(spark, d):
    k = assembly.kept(assembly.fused(candidates(spark, d)).withColumn("score", F.round("score", 12)))
    plan = asked(spark, d).select("query_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("item")).withColumn("target", F.col("item")).withColumn("managed", F.col("item") < 3)
    outcomes = candidates(spark, d).select("query_id", "target").distinct().withColumn("status", F.lit("fulfilled"))
    r = assembly.response(plan, outcomes, k)
    return r.select("query_id", "item", "status", F.coalesce(F.size("chunks"), F.lit(0)).cast("long").alias("n_chunks"), "truncated")


@query(f"""WITH v AS ({E}), s AS (SELECT q.vec_id AS query_id, q.label = c.label AS relevant, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, c.e), 12) DESC, c.vec_id) AS rank FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id QUALIFY rank <= 10),
f AS (SELECT query_id, min(rank) FILTER (relevant) AS first FROM s GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 9) AS recall_at_5, round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0.0 END), 9) AS mrr_at_10 FROM f""")
def a18_a22_retrieval_quality(spark, d):
    from ..operators import evaluation

    hits = search.top_k(vectors(spark, d), asked(spark, d), 11).where("query_id <> id").drop("rank", "scope")
    labels = vectors(spark, d).select("id", F.col("scope").alias("label"))
    want = labels.select(F.col("id").alias("query_id"), F.col("label").alias("wanted"))
    return evaluation.retrieval_quality(hits.join(labels, "id").join(want, "query_id").withColumn("relevant", F.col("label") == F.col("wanted")))
