"""Document structure, lineage and incremental maintenance over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import identity, text as T
from ..operators import evaluation, lineage as L, structure as S
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


def docs(spark, d) -> DataFrame:
    return read(spark, d, "documents")


@query()
def d1_d2_d3_blocks(spark, d):
    return S.block_table(docs(spark, d)).drop("section")


@query()
def d7_d8_d9_semantic_units(spark, d):
    return S.unit_table(docs(spark, d))


@query()
def d11_d14_w9_chunks(spark, d):
    return S.linked(S.chunk_table(docs(spark, d))).drop("slices", "text")


@query("SELECT CAST(NULL AS BIGINT) AS doc_id, '' AS problem WHERE false")
def d4_d6_d15_d16_violations(spark, d):
    """The checks that every parsed, segmented and chunked document must pass: no rows."""
    return S.violations(docs(spark, d))


LINES = r"""lines AS (SELECT doc_id, CAST(o - 1 AS INTEGER) AS ord, line AS text, 'paragraph' AS kind FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\n'), 1) AS o FROM documents) WHERE trim(line) <> '')"""


def lines(x: DataFrame) -> DataFrame:
    t = x.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text")).where(F.trim("text") != "")
    return t.withColumn("kind", F.lit("paragraph"))


@query(f"""WITH {LINES}, t AS (SELECT doc_id, ord, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), 1) AS pos FROM lines),
n AS (SELECT doc_id, term, count(*) AS n, min(ord * 1000000 + pos) AS place FROM t WHERE length(term) <= 64 AND (length(term) >= 2 OR regexp_full_match(term, '\\p{{N}}')) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place, term) AS r FROM n)
SELECT doc_id, array_to_string(list_sort(list(term)), ' ') AS keywords FROM r WHERE r <= 32 GROUP BY doc_id""")
def d17_t7_keywords(spark, d):
    return S.keywords(lines(docs(spark, d))).withColumn("keywords", F.array_join("keywords", " "))


def two_versions(spark, d):
    """Lines of each document, and of its next version: some lines go, some change, some move."""
    p = lines(docs(spark, d))
    change = F.pmod(F.xxhash64("doc_id", "ord"), F.lit(20))
    c = p.where(change != 0).withColumn("text", F.when(change == 1, F.concat("text", F.lit(" revised"))).otherwise(F.col("text")))
    c = c.withColumn("ord", F.when(change == 2, F.col("ord") + 100_000).otherwise(F.col("ord")))
    shape = lambda x: x.select("doc_id", "ord", "kind", "text", F.lit("").alias("section"), T.digest(F.col("text")).alias("digest"))
    return shape(p), shape(c)


@query()
def m1_m6_jn17_block_matches(spark, d):
    return L.match_blocks(*two_versions(spark, d))


_HEADS = LINES + """, b AS (SELECT doc_id, ord, ord % 4 = 0 AS head, CASE WHEN ord % 4 = 0 THEN 1 + (ord // 4) % 2 END AS level, ord % 4 <> 0 AND (doc_id + ord) % 3 = 0 AS matched FROM lines),
h AS (SELECT doc_id, ord, level, (SELECT min(x.ord) FROM b x WHERE x.doc_id = b.doc_id AND x.ord > b.ord AND x.head AND x.level <= b.level) AS past, (SELECT min(x.ord) FROM b x WHERE x.doc_id = b.doc_id AND x.ord > b.ord AND x.matched) AS anchor FROM b WHERE head),
p AS (SELECT doc_id, ord AS current, (SELECT max(x.ord) FROM b x WHERE x.doc_id = h.doc_id AND x.ord < anchor AND x.head AND x.level = h.level) AS previous FROM h WHERE anchor IS NOT NULL AND (past IS NULL OR anchor < past))"""


@query(f"WITH {_HEADS} SELECT doc_id, previous, min(current) AS current FROM p WHERE previous IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1")
def m5_anchored_headings(spark, d):
    x = lines(docs(spark, d)).select("doc_id", "ord")
    head = F.col("ord") % 4 == 0
    b = x.select("doc_id", "ord", F.when(head, "heading").otherwise("paragraph").alias("kind"), F.when(head, 1 + F.floor(F.col("ord") / 4) % 2).alias("level"))
    same = b.where(~head & ((F.col("doc_id") + F.col("ord")) % 3 == 0)).select("doc_id", F.col("ord").alias("previous"), F.col("ord").alias("current"))
    return L.anchored_headings(b, b, same)


@query()
def m10_jn8_w10_block_changes(spark, d):
    p, c = two_versions(spark, d)
    return L.block_changes(p, c, L.match_blocks(p, c).select("doc_id", "previous", "current"))


EDITED = LINES + """, prev AS (SELECT doc_id, ord, 'sha256:' || sha256(text) AS digest FROM lines), cur AS (SELECT doc_id, ord, 'sha256:' || sha256(CASE WHEN (doc_id + ord) % 9 = 1 THEN text || ' revised' ELSE text END) AS digest FROM lines WHERE (doc_id + ord) % 9 <> 0)"""


def edited(spark, d):
    p = lines(docs(spark, d))
    k = (F.col("doc_id") + F.col("ord")) % 9
    c = p.where(k != 0).withColumn("text", F.when(k == 1, F.concat("text", F.lit(" revised"))).otherwise(F.col("text")))
    shape = lambda x: x.select("doc_id", "ord", T.digest(F.col("text")).alias("digest"))
    return shape(p), shape(c)


@query(f"""WITH {EDITED}, u AS (SELECT doc_id, digest, min(ord) AS previous FROM prev GROUP BY 1, 2 HAVING count(*) = 1), v AS (SELECT doc_id, digest, min(ord) AS current FROM cur GROUP BY 1, 2 HAVING count(*) = 1)
SELECT doc_id, digest, previous, current FROM u JOIN v USING (doc_id, digest)""")
def m1_m2_unique_matches(spark, d):
    p, c = edited(spark, d)
    return L.unique_matches(p, c, ["digest"]).select("doc_id", "digest", "previous", "current")


@query(f"""WITH {EDITED}, p AS (SELECT DISTINCT digest FROM prev), c AS (SELECT DISTINCT digest FROM cur)
SELECT digest AS revision, 'embed' AS operation FROM c WHERE digest NOT IN (SELECT digest FROM p) UNION ALL SELECT digest, 'reuse' FROM c WHERE digest IN (SELECT digest FROM p) UNION ALL SELECT digest, 'delete' FROM p WHERE digest NOT IN (SELECT digest FROM c)""")
def m13_jn10_operations(spark, d):
    p, c = (x.withColumnRenamed("digest", "revision") for x in edited(spark, d))
    return L.operations(p, c)


@query(f"""WITH {EDITED}, a AS (SELECT digest, count(*) AS n FROM prev GROUP BY 1), b AS (SELECT digest, count(*) AS n FROM cur GROUP BY 1)
SELECT coalesce(a.digest, b.digest) AS digest, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'incremental' ELSE 'rebuilt' END AS only_in, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS n FROM a FULL JOIN b ON a.digest = b.digest WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def m15_equivalence_violations(spark, d):
    p, c = (x.select("digest") for x in edited(spark, d))
    return L.equivalence_violations(p, c).groupBy("digest", "only_in").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, u AS (SELECT doc_id, ord // 4 AS unit, ord FROM lines), v AS (SELECT doc_id, (ord + 1) // 4 AS unit, ord FROM lines),
un AS (SELECT doc_id, unit, count(*) AS n FROM u GROUP BY 1, 2), vn AS (SELECT doc_id, unit, count(*) AS n FROM v GROUP BY 1, 2),
s AS (SELECT u.doc_id, u.unit AS previous, v.unit AS current, count(*) AS k FROM u JOIN v USING (doc_id, ord) GROUP BY 1, 2, 3),
j AS (SELECT s.doc_id, previous, current, k / CAST(un.n + vn.n - k AS DOUBLE) AS score FROM s JOIN un ON un.doc_id = s.doc_id AND un.unit = previous JOIN vn ON vn.doc_id = s.doc_id AND vn.unit = current),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, previous ORDER BY score DESC, current) AS a, coalesce(lead(score) OVER (PARTITION BY doc_id, previous ORDER BY score DESC, current), 0) AS an,
  row_number() OVER (PARTITION BY doc_id, current ORDER BY score DESC, previous) AS b, coalesce(lead(score) OVER (PARTITION BY doc_id, current ORDER BY score DESC, previous), 0) AS bn FROM j)
SELECT doc_id, CAST(previous AS INTEGER) AS previous, CAST(current AS INTEGER) AS current, round(score, 9) AS score FROM r WHERE a = 1 AND b = 1 AND score >= 0.6 AND score - greatest(an, bn) >= 0.15""")
def m8_t9_jn18_unit_lineage(spark, d):
    x = lines(docs(spark, d)).select("doc_id", "ord")
    unit = lambda k: x.groupBy("doc_id", F.floor((F.col("ord") + k) / 4).cast("int").alias("u")).agg(F.array_sort(F.collect_list("ord")).alias("blocks")).select("doc_id", F.col("u").alias("ord"), F.lit("section").alias("kind"), "blocks")
    return L.unit_matches(unit(0), unit(1)).withColumn("score", F.round("score", 9))


@query(f"""WITH {LINES}, g AS (SELECT doc_id, ord AS gap_at, CASE WHEN ord % 5 = 0 THEN 1 ELSE 0 END AS e, CASE WHEN ord % 4 = 0 THEN 1 ELSE 0 END AS p FROM lines),
w AS (SELECT *, sum(e) OVER x AS se, sum(p) OVER x AS sp, count(*) OVER x AS n FROM g WINDOW x AS (PARTITION BY doc_id ORDER BY gap_at ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
a AS (SELECT doc_id, sum(e * p) AS tp, sum(p) AS np, sum(e) AS ne, coalesce(avg(CASE WHEN n = 3 THEN CAST((se > 0) <> (sp > 0) AS INT) END), 0) AS pk, coalesce(avg(CASE WHEN n = 3 THEN CAST(se <> sp AS INT) END), 0) AS wd FROM w GROUP BY 1),
b AS (SELECT *, CASE WHEN np > 0 THEN tp / np WHEN ne = 0 THEN 1.0 ELSE 0.0 END AS pr, CASE WHEN ne > 0 THEN tp / ne WHEN np = 0 THEN 1.0 ELSE 0.0 END AS re FROM a)
SELECT doc_id, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 9) AS f1, round(pk, 9) AS pk, round(wd, 9) AS window_diff FROM b""")
def a19_boundary_quality(spark, d):
    g = lines(docs(spark, d)).select("doc_id", F.col("ord").alias("at"), (F.col("ord") % 5 == 0).cast("int").alias("expected"), (F.col("ord") % 4 == 0).cast("int").alias("predicted"))
    q = evaluation.boundary_quality(g, 3)
    return q.select("doc_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "pk", "window_diff")])


@query(f"WITH {LINES} SELECT doc_id, 'sha256:' || sha256(array_to_string(list_sort(list(d)), chr(10))) AS digest FROM (SELECT doc_id, 'sha256:' || sha256(text) AS d FROM lines) GROUP BY 1")
def a9_a10_record_set_digest(spark, d):
    x = lines(docs(spark, d)).select("doc_id", T.digest(F.col("text")).alias("d"))
    return x.groupBy("doc_id").agg(identity.set_digest(F.collect_list("d")).alias("digest"))


@query("""WITH c AS (SELECT doc_id, '{' || array_to_string(list_filter([CASE WHEN lang IS NOT NULL THEN '"lang":"' || lang || '"' END, CASE WHEN n_chars IS NOT NULL THEN '"n_chars":' || n_chars END, CASE WHEN source IS NOT NULL THEN '"source":"' || source || '"' END], lambda x: x IS NOT NULL), ',') || '}' AS canonical FROM documents),
h AS (SELECT *, sha256(canonical) AS hex FROM c),
b AS (SELECT *, list_reduce(list_transform(range(1, 65), lambda i: right(bin(position(hex[i] IN '0123456789abcdef') + 15), 4)), lambda x, y: x || y) || '0000' AS b FROM h)
SELECT doc_id, canonical, 'rev_' || list_reduce(list_transform(range(0, 52), lambda i: 'abcdefghijklmnopqrstuvwxyz234567'[1
  + 16 * CAST(b[5 * i + 1] AS INT) + 8 * CAST(b[5 * i + 2] AS INT) + 4 * CAST(b[5 * i + 3] AS INT) + 2 * CAST(b[5 * i + 4] AS INT) + CAST(b[5 * i + 5] AS INT)]), lambda x, y: x || y) AS revision FROM b""")
def f6_f7_r10_r11_revision_ids(spark, d):
    x = docs(spark, d).select("doc_id", F.to_json(F.struct("lang", "source", "n_chars")).alias("j"))
    return x.select("doc_id", identity.canonical_json_column(F.col("j")).alias("canonical"), identity.revision_column("rev", F.col("j")).alias("revision"))
